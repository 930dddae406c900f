"""Stack detection over a file inventory: rules are data, evaluated in one pass over the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.operators.ranks import first_per_group, running_sums

from metaloom.functions.scalar import matches
from metaloom.operators.signals import rule_hits

#: Folders to skip; languages by extension, with those that count as primary; packages that name frameworks.
SKIP = (".git", ".vs", "bin", "obj", "node_modules")
LANGUAGES = {
    "cs": "C#", "razor": "Razor (Blazor)", "cshtml": "Razor (MVC/Pages)", "html": "HTML", "css": "CSS", "scss": "SCSS", "js": "JavaScript", "ts": "TypeScript", "py": "Python", "json": "JSON", "xml": "XML",
    "yml": "YAML", "yaml": "YAML", "bicep": "Bicep", "sql": "SQL", "md": "Markdown", "sh": "Shell", "ps1": "PowerShell", "dockerfile": "Dockerfile",
}
PRIMARY = ("C#", "Razor (Blazor)", "Razor (MVC/Pages)", "JavaScript", "TypeScript", "Python", "SQL", "Bicep")
FRAMEWORKS = (
    (r"Microsoft\.AspNetCore\.Components\.WebAssembly", "Blazor WebAssembly"),
    (r"Microsoft\.AspNetCore\.Components", "Blazor Server"),
    (r"Microsoft\.AspNetCore\.Mvc", "ASP.NET Core MVC"),
    (r"Microsoft\.AspNetCore\.Identity", "ASP.NET Core Identity"),
    (r"Microsoft\.AspNetCore\.Authentication\.JwtBearer", "JWT Bearer Auth"),
    (r"Microsoft\.EntityFrameworkCore", "Entity Framework Core"),
    (r"MediatR", "MediatR (CQRS)"),
    (r"AutoMapper", "AutoMapper"),
    (r"FluentValidation", "FluentValidation"),
    (r"Ardalis\.Specification", "Ardalis Specification (Repository)"),
    (r"Ardalis\.ApiEndpoints", "Ardalis API Endpoints"),
    (r"Ardalis\.GuardClauses", "Ardalis Guard Clauses"),
    (r"MinimalApi\.Endpoint", "Minimal API"),
    (r"Azure\.Identity", "Azure Identity"),
    (r"Azure\.Extensions\.AspNetCore\.Configuration\.Secrets", "Azure Key Vault"),
    (r"Swashbuckle", "Swagger / OpenAPI"),
    (r"xunit", "xUnit"),
    (r"NSubstitute", "NSubstitute"),
    (r"Microsoft\.AspNetCore\.Mvc\.Testing", "ASP.NET Core Integration Testing"),
    (r"Blazored\.LocalStorage", "Blazored LocalStorage"),
)
#: Databases by package and by settings.
DB_PACKAGES = (
    (r"EntityFrameworkCore\.SqlServer", "SQL Server (EF Core)"),
    (r"EntityFrameworkCore\.InMemory", "In-Memory DB (EF Core)"),
    (r"EntityFrameworkCore\.Sqlite", "SQLite (EF Core)"),
    (r"EntityFrameworkCore\.Cosmos", "Azure Cosmos DB"),
    (r"Npgsql", "PostgreSQL"),
    (r"MySql\.Data|Pomelo\.EntityFrameworkCore\.MySql", "MySQL"),
    (r"MongoDB", "MongoDB"),
    (r"Redis|StackExchange\.Redis", "Redis"),
    (r"Azure\.Storage", "Azure Blob Storage"),
)
DB_CONFIG = (
    (r"Server=|Data Source=.*\.mdf|sqlserver", "SQL Server"),
    (r"Host=.*port=5432|postgresql", "PostgreSQL"),
    (r"\.db\b|sqlite", "SQLite"),
    (r"mongodb\+srv|mongodb://", "MongoDB"),
    (r"redis://|6379", "Redis"),
    (r"AccountEndpoint.*cosmos|cosmos\.azure\.com", "Azure Cosmos DB"),
)
#: Fixed values: (architecture, signals, how many are needed, signals against it).
ARCHITECTURES = (
    ("Clean Architecture", (r"/ApplicationCore/|/Application/|/Domain/", r"/Infrastructure/"), 1, ()),
    ("DDD (Domain-Driven Design)", (r"Aggregate|AggregateRoot|ValueObject|DomainEvent", r"/Entities/.*Aggregate|IAggregateRoot"), 1, ()),
    ("CQRS", (r"IRequest|IRequestHandler|MediatR|Command|Query",), 1, ()),
    ("Repository Pattern", (r"IRepository|EfRepository|IAsyncRepository|Specification",), 1, ()),
    ("Minimal API", (r"IEndpoint|MapGet|MapPost|MinimalApi|ApiEndpoints",), 1, ()),
    ("MVC", (r"Controller|ActionResult|IActionResult|ViewResult",), 1, ()),
    ("Microservices", (r"ServiceBus|EventBus|MessageBroker|Dapr|NServiceBus|MassTransit|RabbitMQ|Kafka", r"ApiGateway|Ocelot|YARP\.ReverseProxy|nginx.*upstream", r"IIntegrationEvent|IntegrationEventHandler|OutboxMessage"), 2, (r"DbContext\b",)),
    ("Layered Monolith", (r"/Infrastructure/|/DataAccess/|/Persistence/", r"/ApplicationCore/|/Application/|/Domain/|/Business/"), 2, ()),
    ("Modular Monolith", (r"/Modules/|/Features/|/Slices/", r"IModule\b|ModuleInitializer|FeatureManagement"), 2, ()),
)
#: What a file is for, by its path; the first kind that fits.
BUCKETS = (
    ("quality", (r"/tests/|/Tests/|\.Tests\.|Spec\.cs$|Tests\.cs$", r"FunctionalTest|IntegrationTest|UnitTest|xunit|NSubstitute", r"\.runsettings$")),
    ("data", (r"/Infrastructure/Data/|/Migrations/|DbContext|/Config/.*Config\.cs", r"\.sql$|EntityTypeConfiguration|IEntityTypeConfiguration", r"/Entities/|/Models/|Entity\.cs|DbSet")),
    ("integration", (r"/PublicApi/|/Controllers/|/Endpoints/|/Api/", r"Controller\.cs|Endpoint\.cs|MapGet|MapPost", r"appsettings.*\.json$|Program\.cs$|Startup\.cs$", r"docker-compose|Dockerfile|\.bicep$|azure\.yaml$")),
    ("business", (r"/ApplicationCore/Services/|/Services/.*Service\.cs", r"/Specifications/|/Interfaces/|/Domain/|/UseCases/", r"Handler\.cs|Command\.cs|Query\.cs|IUseCase", r"/ApplicationCore/Entities/")),
    ("architect", (r"/Interfaces/|/Abstractions/|/Contracts/", r"IRepository|IService|IUnitOfWork|IAggregateRoot", r"/ApplicationCore/|/Domain/|AggregateRoot|ValueObject", r"README\.md$|\.sln$|Directory\.Packages\.props$")),
)
#: Fixed values: (layer, project names, signals in its C# files); tests by name.
LAYERS = (
    ("domain", r"(Domain|ApplicationCore|Application\.Core|DomainModel|BusinessCore|DomainEntities|\.Core$)", r"IAggregateRoot|IValueObject|AggregateRoot\b|ValueObject\b|IDomainEvent|DomainEvent\b|IEntity\b"),
    ("infrastructure", r"(Infrastructure|\.Data$|\.Persistence$|DataAccess|Repository|Repositories|EntityFramework|\.EF$|\.Dal$)", r"DbContext\b|IEntityTypeConfiguration|DbSet<|MigrationBuilder|EfRepository\b|IAsyncRepository"),
    ("api", r"(PublicApi|WebApi|\.Api$|\.API$|ApiHost|Endpoints|ApiGateway|RestApi|GrpcService|GraphQL)", r"\[ApiController\]|\[Route\(|ControllerBase\b|IEndpoint\b|MapGet\(|MapPost\(|MapPut\(|MapDelete\("),
    ("web", r"(\.Web$|\.WebApp$|\.Mvc$|\.Blazor$|\.BlazorServer$|\.BlazorWasm$|\.Pages$|\.UI$|\.Portal$|\.Frontend$)", r"PageModel\b|IActionResult\b|ViewResult\b|RazorPage|@inject\b|@model\b|\.cshtml\b"),
)
TEST_NAME = r"(Tests?|Specs?|IntegrationTests?|UnitTests?|FunctionalTests?|E2ETests?|AcceptanceTests?)"
DIALECTS = (
    ("sqlserver", r"\[dbo\]|\bGO\b|\bIDENTITY\b|nvarchar\b|\bNOCOUNT\b"),
    ("postgresql", r"\bSERIAL\b|\bBIGSERIAL\b|\bRETURNING\b|\$\d+\b|pg_catalog"),
    ("mysql", r"\bAUTO_INCREMENT\b|ENGINE\s*=\s*InnoDB|`\w+`\s+`\w+`"),
)
#: Object mappers, the shape of the whole, interface styles and databases by words anywhere in the sample.
ORMS = (
    ("ef_core", r"(?i)Microsoft\.EntityFrameworkCore|DbContext|DbSet<", 0.9),
    ("spring_jpa", r"spring-boot-starter-data-jpa|@Entity\b|JpaRepository", 0.9),
    ("hibernate", r"(?i)hibernate-core|SessionFactory|@Table\b", 0.7),
    ("django_orm", r"(?i)from django\.db import models|models\.Model", 0.9),
    ("sqlalchemy", r"(?i)from sqlalchemy|import sqlalchemy|declarative_base", 0.8),
    ("sequelize", r"(?i)\"sequelize\"|DataTypes\.|Model\.init", 0.8),
    ("mongoose", r"(?i)\"mongoose\"|new Schema\(|mongoose\.model\(", 0.8),
    ("typeorm", r"(?i)\"typeorm\"|@Entity\(\)|createConnection", 0.8),
    ("prisma", r"(?i)\"@prisma/client\"|prisma\.|PrismaClient", 0.9),
)
SHAPES = (
    ("microservices", (r"ServiceBus|EventBus|MassTransit|RabbitMQ|Kafka|NServiceBus", r"ApiGateway|Ocelot|YARP\.ReverseProxy", r"IIntegrationEvent|IntegrationEventHandler"), 2, r"DbContext\b"),
    ("modular_monolith", (r"IModule|ModuleRegistration|\.Modules\b", r"AddModule\(|UseModule\("), 2, ""),
    ("layered_monolith", (r"Domain|Application|Infrastructure|Presentation", r"IRepository|IService|IUseCase"), 1, ""),
)
STYLES = (
    ("aspnet_core", r"(?i)Microsoft\.AspNetCore"),
    ("spring_mvc", r"@RestController|@Controller|@GetMapping"),
    ("django_rest", r"(?i)rest_framework|APIView|ViewSet"),
    ("fastapi", r"(?i)from fastapi|import fastapi|@app\.(get|post)"),
    ("flask", r"(?i)from flask|import flask|@app\.route"),
    ("express", r"(?i)require\(['\"]express"),
    ("graphql", r"(?i)graphql|@Query\b|@Mutation\b"),
    ("grpc", r"(?i)\.proto\b|grpc\b|protobuf"),
)
CODE_LANGUAGES = {"cs": "csharp", "java": "java", "kt": "kotlin", "py": "python", "ts": "typescript", "js": "javascript"}


def listed(files: DataFrame) -> DataFrame:
    """Files without a skipped folder on their path."""
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP))))


def extension(path: str = "path"):
    """The extension in lower case; a Dockerfile has none and counts as its own."""
    return F.when(F.col(path).rlike(r"(?i)(^|/)dockerfile$"), "dockerfile").otherwise(F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))


def languages(files: DataFrame) -> DataFrame:
    """Files of each language, whether it is a primary one, and its place: more files first, then by name."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    counts = listed(files).withColumn("language", F.try_element_at(names, extension())).where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("language", "n", F.col("language").isin(*PRIMARY).alias("is_primary"), F.row_number().over(Window.orderBy(F.desc("n"), "language")).alias("place"))


def packages(files: DataFrame) -> DataFrame:
    """Packages that project files name."""
    return listed(files).where("path LIKE '%.csproj' OR path LIKE '%.props'").select("path", F.explode(F.expr("xpath(text, '//PackageReference/@Include')")).alias("package"))


def config_text(files: DataFrame) -> DataFrame:
    """The settings files in path order, joined by a line feed."""
    return listed(files).where("path RLIKE 'appsettings[^/]*\\\\.json$'").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: x.text), "\n").alias("config"))


def source_sample(files: DataFrame, k: int = 30, chars: int = 2000) -> DataFrame:
    """The first k C# files by path, their first chars characters."""
    return listed(files).where("path LIKE '%.cs'").orderBy("path").limit(k).select("path", F.substring("text", 1, chars).alias("sample"))


#: The globs of a signal sample, files of packages and settings before sources.
PRIORITY_GLOBS = ("*.csproj", "pom.xml", "build.gradle", "build.gradle.kts", "requirements.txt", "pyproject.toml", "Pipfile", "package.json", "appsettings*.json", "application*.properties", "application*.yml", "docker-compose*.yml")
SOURCE_GLOBS = ("*.cs", "*.java", "*.py", "*.ts", "*.js", "*.kt", "*.sql")
PRIORITY_CHARS, SOURCE_CHARS, SOURCES_PER_GLOB, SOURCES, SAMPLE_CHARS = 20_000, 10_000, 15, 30, 500_000


def _globbed(files: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    """A row for each file and glob that fits its name; place is the glob's."""
    name = F.element_at(F.split("path", "/"), -1)
    as_regex = lambda g: "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in ".+()[]{}^$|\\" else c for c in g) + "$"
    fits = F.array_compact(F.array(*[F.when(name.rlike(as_regex(g)), F.lit(i)) for i, g in enumerate(globs)]))
    return files.withColumn("glob", F.explode(fits))


def scanned_text(files: DataFrame, globs: tuple[str, ...], n: int = 30) -> DataFrame:
    """(glob, path, text): the first n files by path of each glob, in the order of globs."""
    return first_per_group(_globbed(files, globs).select("glob", "path", "text"), ["glob"], ["path"], n)


def signal_sample(files: DataFrame, chars: int = SAMPLE_CHARS, sources: int = SOURCES) -> DataFrame:
    """(place, path, chunk, chars_before): beginnings of files by glob and path, packages and settings first, then
    the first files of each source glob, up to the one with which the characters pass the budget or the sources reach theirs.
    Sums run over ranges (ranks.running_sums), whatever the number of files."""
    first = listed(_globbed(files, PRIORITY_GLOBS)).select("glob", "path", F.left("text", F.lit(PRIORITY_CHARS)).alias("chunk"), F.lit(0).alias("source"))
    code = listed(first_per_group(_globbed(files, SOURCE_GLOBS).select("glob", "path", "text"), ["glob"], ["path"], SOURCES_PER_GLOB))
    code = code.select((F.col("glob") + len(PRIORITY_GLOBS)).alias("glob"), "path", F.left("text", F.lit(SOURCE_CHARS)).alias("chunk"), F.lit(1).alias("source"))
    size = F.coalesce(F.length("chunk"), F.lit(0))
    order = [F.col("glob"), F.col("path")]
    summed = running_sums(first.unionByName(code), order, chars=size, seen=F.col("source"), place=F.lit(1))
    before = F.col("chars") - size
    return summed.where((before <= chars) & (F.col("seen") - F.col("source") < sources)).select((F.col("place") - 1).alias("place"), "path", "chunk", before.alias("chars_before"))


def budgeted(files: DataFrame, budget: int) -> DataFrame:
    """Files by priority (SQL, C#, others) and path while their sizes fit the budget."""
    prio = F.when(F.col("path").endswith(".sql"), 0).when(F.col("path").endswith(".cs"), 1).otherwise(2)
    w = Window.orderBy("prio", "path").rowsBetween(Window.unboundedPreceding, 0)
    return listed(files).withColumn("prio", prio).withColumn("running", F.sum("size").over(w)).where(F.col("running") <= budget).select("path", "running")


def _hits(df: DataFrame, column: str, rules: tuple, name: str) -> DataFrame:
    """(column, name) for each rule whose pattern a row's column has, with the rule's number."""
    each = F.array_compact(F.array(*[F.when(matches(F.col(column), p), F.struct(F.lit(i).alias("no"), F.lit(n).alias(name))) for i, (p, n) in enumerate(rules)]))
    return df.select(column, F.explode(each).alias("h")).select(column, "h.no", f"h.{name}")


def frameworks(files: DataFrame) -> DataFrame:
    """A framework by the first package (by name) that names it, else by source."""
    by_package = _hits(packages(files), "package", FRAMEWORKS, "framework").groupBy("framework").agg(F.min("package").alias("via"), F.lit(0).alias("o"))
    in_source = rule_hits(source_sample(files), [(n, "(?i)" + p) for p, n in FRAMEWORKS], text="sample")
    by_source = in_source.select(F.col("rule").alias("framework"), F.lit("source-code").alias("via"), F.lit(1).alias("o"))
    return by_package.union(by_source.distinct()).groupBy("framework").agg(F.min_by("via", "o").alias("via"))


def databases(files: DataFrame) -> DataFrame:
    """Databases by package (the first by name), then by settings; the first source of a name wins."""
    p = _hits(packages(files), "package", DB_PACKAGES, "db").groupBy("db").agg(F.min("package").alias("via")).select("db", "via", F.lit("package").alias("source"), F.lit(0).alias("o"))
    c = _hits(config_text(files), "config", DB_CONFIG, "db").select("db", F.lit("appsettings.json").alias("via"), F.lit("config").alias("source"), F.lit(1).alias("o"))
    both = p.union(c).groupBy("db").agg(F.min(F.struct("o", "via", "source")).alias("m"))
    return both.select("db", "m.via", "m.source")


def _seen(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """One row: for each (name, pattern), whether a listed path, package or source sample has it."""
    texts = listed(files).select(F.col("path").alias("t")).union(packages(files).select("package")).union(source_sample(files).select("sample"))
    return _flags(texts, [(n, "(?i)" + p) for n, p in patterns])


def _flags(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """One row: for each (name, pattern), whether some text t has it. The texts are read once for all patterns."""
    hits = rule_hits(texts.select(F.lit(0).alias("path"), F.col("t").alias("text")), patterns).select("rule").distinct()
    found = hits.agg(F.collect_set("rule").alias("found"))  # the rules' names at most
    return found.select(*[F.array_contains("found", n).alias(n) for n, _ in patterns])


def architectures(files: DataFrame) -> DataFrame:
    """Architectures with enough signals and none against them; confidence high if all are seen."""
    signals = [(f"a{i}_{j}", p) for i, (_, ps, _, _) in enumerate(ARCHITECTURES) for j, p in enumerate(ps)]
    against = [(f"x{i}_{j}", p) for i, (_, _, _, xs) in enumerate(ARCHITECTURES) for j, p in enumerate(xs)]
    number = lambda prefix, i, k: sum((F.col(f"{prefix}{i}_{j}").cast("int") for j in range(k)), F.lit(0))
    rows = F.array(*[F.struct(F.lit(n).alias("architecture"), number("a", i, len(ps)).alias("matched"), F.lit(len(ps)).alias("total"), F.lit(least).alias("least"), number("x", i, len(xs)).alias("against")) for i, (n, ps, least, xs) in enumerate(ARCHITECTURES)])
    hits = _seen(files, signals + against).select(F.explode(rows).alias("r")).select("r.*").where("matched >= least AND against = 0")
    return hits.select("architecture", "matched", "total", F.when(F.col("matched") == F.col("total"), "high").otherwise("medium").alias("confidence"))


def file_map(files: DataFrame) -> DataFrame:
    """The first kind whose rules the path matches; other C# and Razor files count as architect."""
    b = F
    for name, patterns in BUCKETS:
        b = b.when(matches(F.col("path"), "|".join(f"(?:{p})" for p in patterns)), F.lit(name))
    return listed(files).select("path", b.otherwise(F.when(F.col("path").rlike(r"\.(cs|razor|cshtml)$"), "architect")).alias("bucket")).where("bucket IS NOT NULL")


def layers(files: DataFrame) -> DataFrame:
    """Projects by the folder of a project file: the name counts .5, each signal in C# files .05 up to .5; test
    names decide at once; the best layer from .05 on, the first of equals."""
    projects = listed(files).where("path LIKE '%.csproj'").select(F.regexp_extract("path", r"^(.*/)?[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.csproj$", 1).alias("project"))
    code = listed(files).where("path LIKE '%.cs'").select("path", "text")
    parts = code.select("path", "text", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i), "/"), F.lit("/"))))).alias("folder"))
    counts = projects.join(parts, "folder", "left").groupBy("folder", "project").agg(*[F.sum(F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0))).alias(n) for n, _, p in LAYERS])
    score = [F.struct((F.when(matches(F.col("project"), name), 0.5).otherwise(0.0) + F.least(F.col(n) * 0.05, F.lit(0.5))).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("layer")) for i, (n, name, _) in enumerate(LAYERS)]
    test = matches(F.col("project"), TEST_NAME)
    best = counts.withColumn("b", F.greatest(*score))
    return best.select("project", F.when(test, "test").when(F.col("b.s") < 0.05, "other").otherwise(F.col("b.layer")).alias("layer"), F.when(test, 0.95).when(F.col("b.s") < 0.05, 0.0).otherwise(F.least(F.col("b.s"), F.lit(1.0))).alias("confidence"))


def dialects(files: DataFrame) -> DataFrame:
    """The dialect of each of the first ten SQL files, by its first 4000 characters."""
    b = F
    for name, p in DIALECTS:
        b = b.when(matches(F.col("sample"), p), F.lit(name))
    return listed(files).where("path LIKE '%.sql'").orderBy("path").limit(10).select("path", F.substring("text", 1, 4000).alias("sample")).select("path", b.otherwise("sqlite").alias("dialect"))


def tech_context(files: DataFrame) -> DataFrame:
    """(kind, name, place) of languages (by number of files), object mappers (by weight), interface styles and the
    shape of the whole, and the confidence: .4, .1 for each of up to four languages and of two mappers."""
    code = F.create_map(*[F.lit(x) for kv in CODE_LANGUAGES.items() for x in kv])
    langs = listed(files).select(F.try_element_at(code, extension()).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    rules = [(f"o{i}", p) for i, (_, p, _) in enumerate(ORMS)] + [(f"s{i}", p) for i, (_, p) in enumerate(STYLES)] + [(f"m{i}_{j}", "(?i)" + p) for i, (_, ps, _, _) in enumerate(SHAPES) for j, p in enumerate(ps)] + [(f"n{i}", "(?i)" + x) for i, (_, _, _, x) in enumerate(SHAPES) if x]
    texts = listed(files).select(F.col("text").alias("t"))
    seen = _flags(texts, rules)
    shape = F
    for i, (name, ps, least, x) in enumerate(SHAPES):
        enough = sum((F.col(f"m{i}_{j}").cast("int") for j in range(len(ps))), F.lit(0)) >= least
        shape = shape.when(enough & ~F.col(f"n{i}") if x else enough, name)
    row = lambda kind, name, place: F.struct(F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name"), place.alias("place"))
    order = {n: k for k, (n, _, _) in enumerate(sorted(ORMS, key=lambda o: -o[2]))}
    listing = [F.when(F.col(f"o{i}"), row("orm", n, F.lit(order[n]))) for i, (n, _, _) in enumerate(ORMS)] + [F.when(F.col(f"s{i}"), row("api_style", n, F.lit(i))) for i, (n, _) in enumerate(STYLES)] + [row("architecture", shape.otherwise("unknown"), F.lit(0))]
    found = seen.select(F.explode(F.array_compact(F.array(*listing))).alias("r")).select("r.*")
    ranked = langs.select(F.lit("language").alias("kind"), "name", (F.row_number().over(Window.orderBy(F.desc("n"), "name")) - 1).alias("place"))
    both = ranked.union(found)
    counts = both.agg(F.count_if(F.col("kind") == "language").alias("l"), F.count_if(F.col("kind") == "orm").alias("o"))
    weight = F.least(F.lit(1.0), F.round(0.4 + 0.1 * F.least("l", F.lit(4)) + 0.1 * F.least("o", F.lit(2)), 2))
    return both.union(counts.select(F.lit("confidence"), weight.cast("string"), F.lit(0)))
