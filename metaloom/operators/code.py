"""Source text to model rows by built-in regular expressions: endpoints, entities, fields, relations, guards, symbols.

files: (path, text). C# types and their bodies come from metaloom.operators.scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.operators import scopes

#: Guard calls with their rules and confidence; fluent configuration calls; property attributes.
GUARDS = (
    (r"Guard\.Against\.NullOrEmpty\s*\(\s*(\w+)", "not_null", "HIGH"),
    (r"Guard\.Against\.Null\s*\(\s*(\w+)", "not_null", "HIGH"),
    (r"Guard\.Against\.NegativeOrZero\s*\(\s*(\w+)", "positive_value", "HIGH"),
    (r"Guard\.Against\.OutOfRange\s*\(\s*(\w+)", "range", "HIGH"),
    (r"Guard\.Against\.StringTooLong\s*\(\s*(\w+)", "max_length", "HIGH"),
    (r"if\s*\(\s*string\.IsNullOrEmpty\s*\(\s*(\w+)", "not_null", "MEDIUM"),
    (r"throw\s+new\s+ArgumentNullException\s*\(\s*nameof\s*\(\s*(\w+)", "not_null", "MEDIUM"),
    (r"throw\s+new\s+ArgumentException.*nameof\s*\(\s*(\w+)", "validation", "MEDIUM"),
)
FLUENT = (
    (r"IsRequired\(\)", "not_null"),
    (r"HasMaxLength\(\s*\d+\)", "max_length"),
    (r"IsUnicode\(false\)", "unicode"),
    (r"HasIndex\(", "index"),
    (r"IsUnique\(\)", "unique"),
    (r"IsConcurrencyToken\(\)", "concurrency"),
    (r"HasPrecision\(", "precision"),
    (r"HasColumnType\([\"']nvarchar", "nvarchar"),
    (r"HasDefaultValue\(", "default"),
    (r"ValueGeneratedOnAdd", "db_generated"),
)
ATTRIBUTES = {
    "Required": "not_null", "MaxLength": "max_length", "MinLength": "min_length", "StringLength": "string_length", "Key": "primary_key", "Index": "index", "ConcurrencyCheck": "concurrency",
    "Timestamp": "timestamp", "Owned": "owned_entity", "NotMapped": "not_mapped", "CreditCard": "pci_dss", "Encrypted": "encryption", "Sensitive": "sensitive_data", "DataProtection": "encryption",
}
#: Types of model fields by framework, and field-name risks by language.
DJANGO = {
    "CharField": "string", "TextField": "string", "SlugField": "string", "URLField": "string", "EmailField": "string", "FileField": "string", "ImageField": "string", "UUIDField": "uuid",
    "IntegerField": "integer", "BigIntegerField": "integer", "SmallIntegerField": "integer", "PositiveIntegerField": "integer", "AutoField": "integer", "BigAutoField": "integer",
    "FloatField": "decimal", "DecimalField": "decimal", "BooleanField": "boolean", "NullBooleanField": "boolean", "DateField": "date", "DateTimeField": "datetime", "TimeField": "time",
    "DurationField": "duration", "BinaryField": "bytes", "JSONField": "json", "ArrayField": "array", "ForeignKey": "foreign_key", "OneToOneField": "one_to_one", "ManyToManyField": "many_to_many",
}
JAVA = {
    "String": "string", "Integer": "integer", "int": "integer", "Long": "integer", "long": "integer", "Double": "decimal", "double": "decimal", "Float": "decimal", "float": "decimal",
    "BigDecimal": "decimal", "Boolean": "boolean", "boolean": "boolean", "LocalDate": "date", "LocalDateTime": "datetime", "Date": "datetime", "Timestamp": "datetime", "UUID": "uuid", "byte[]": "bytes", "Object": "any",
}
NODE = {
    "string": "string", "String": "string", "number": "decimal", "Number": "decimal", "bigint": "integer", "BigInt": "integer", "boolean": "boolean", "Boolean": "boolean", "Date": "datetime", "Buffer": "bytes",
    "any": "any", "object": "json", "Record": "json", "JSON": "json", "UUID": "uuid", "TEXT": "string", "VARCHAR": "string", "INTEGER": "integer", "BIGINT": "integer", "FLOAT": "decimal", "DOUBLE": "decimal",
    "DECIMAL": "decimal", "BOOLEAN": "boolean", "DATE": "datetime", "DATEONLY": "date", "JSONB": "json", "BLOB": "bytes",
}
RISKS = {
    "python": (r"\b(password|ssn|credit_card|cvv|pin|secret)\b", r"\b(email|phone|address|birth|salary|national_id)\b", r"\b(name|first_name|last_name|username)\b"),
    "java": (r"\b(ssn|social_security|password|passwd|credit_card|card_number|cvv|pin)\b", r"\b(email|phone|mobile|address|birth|dob|salary|tax_id|national_id)\b", r"\b(name|first_name|last_name|full_name|username|user_name)\b"),
    "node": (r"\b(password|passwd|ssn|credit_card|cvv|pin|secret)\b", r"\b(email|phone|address|birthday|dob|salary)\b", r"\b(name|firstName|lastName|username)\b"),
}
PRIMITIVES = "int long short byte sbyte uint ulong ushort float double decimal bool char string object void DateTime DateTimeOffset DateOnly TimeOnly TimeSpan Guid Uri".split()
ROOTS, VALUES = ("IAggregateRoot", "IAggregateRootEntity"), ("ValueObject", "IValueObject")
DTO_ENDS = "Request|Response|Dto|ViewModel|Command|Query|Result|Model"
KINDS = {"OneToMany": "one_to_many", "ManyToOne": "many_to_one", "ManyToMany": "many_to_many", "OneToOne": "one_to_one", "Embedded": "embeds", "ElementCollection": "embeds"}


def _zip(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])


def found(files: DataFrame, suffix: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """path, pos and the named groups of each match in files of a suffix."""
    rows = files.where(F.col("path").endswith(suffix)).select("path", F.posexplode(_zip(F.col("text"), pattern, groups)).alias("pos", "x"))
    return rows.select("path", "pos", *[F.col(f"x.{n}").alias(n) for n in groups])


def _lookup(pairs: dict[str, str], key: Column, default: Column | None = None) -> Column:
    hit = F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)
    return hit if default is None else F.coalesce(hit, default)


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def field_risk(name: Column, language: str) -> Column:
    """High, medium, low or null by the words of a language's list."""
    out = F
    for level, pattern in zip(("high", "medium", "low"), RISKS[language]):
        out = out.when(name.rlike("(?i)" + pattern), level)
    return out


# ---- C#

def types(files: DataFrame) -> DataFrame:
    """The types of C# files with their file's first namespace (ns) and whether it is marked as one of value objects. The
    operators of C# types below take this in place of files, too: cut() it where several read it."""
    if "outline" in files.columns:
        return files
    return scopes.types(files, ns=F.regexp_extract("text", r"(?m)^\s*namespace\s+([\w.]+)", 1), marked=F.col("text").rlike(r"(?i)//\s*ValueObject")).drop("begin", "stop", "depth", "body")


def bodies(files: DataFrame) -> DataFrame:
    """(path, pos, kind, name, body) of C# classes, records and structs with a body; its literals are masked."""
    return types(files).where("kind <> 'interface' AND outline IS NOT NULL").select("path", "pos", "kind", "name", F.col("outline").alias("body"))


def classes(files: DataFrame) -> DataFrame:
    """Path, ns, name, kind, bases, interfaces, is_root and is_value of C# types, with or without a body."""
    is_interface = lambda x: x.rlike("^I[A-Z]")
    rows = types(files).withColumns({"b": F.filter("listed", lambda x: ~is_interface(x)), "i": F.filter("listed", is_interface)})
    is_value = F.col("marked") | (F.col("kind") == "record") | F.arrays_overlap(F.concat("b", "i"), F.array(*map(F.lit, VALUES)))
    return rows.select("path", "ns", "name", "kind", F.array_join("b", ",").alias("bases"), F.array_join("i", ",").alias("interfaces"), F.arrays_overlap("i", F.array(*map(F.lit, ROOTS))).alias("is_root"), is_value.alias("is_value"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name) of namespaces and usings."""
    return found(files, ".cs", r"(?m)^\s*(namespace|using)\s+(?:static\s+)?([\w.]+)\s*[;{]?\s*$", {"kind": 1, "name": 2}).select("path", "kind", "name")


_PROPERTY = r"\bpublic\s+(?:virtual\s+|required\s+|override\s+)*([\w<>?\[\], ]+?)\s+(\w+)\s*\{\s*get;\s*((?:private |protected |internal )?set;|init;)?\s*\}"


def _properties(rows: DataFrame) -> DataFrame:
    base = F.regexp_replace(F.regexp_extract("type", r"^([\w\[\]]+)", 1), r"\?$", "")
    element = F.regexp_extract("type", r"^(?:I?List|ICollection|IEnumerable|IReadOnlyCollection|IReadOnlyList|HashSet)<(\w+)>", 1)
    simple = lambda c: c.isin(*PRIMITIVES) | c.endswith("[]")
    category = F.when((element != "") & ~simple(element), "collection").when((element == "") & ~simple(base), "navigation").when((element == "") & F.col("name").rlike("^.+Id$"), "foreign_key").otherwise("primitive")
    setter = F.when(_text("s") == "", "none").when(F.col("s").startswith("set"), "public").otherwise(F.regexp_extract("s", r"^(\w+)", 1))
    target = F.when(category == "collection", element).when(category == "navigation", base).when(category == "foreign_key", F.regexp_replace("name", "Id$", "")).otherwise("")
    return rows.withColumns({"category": category, "setter": setter, "target": target, "is_collection": element != ""})


def properties(files: DataFrame) -> DataFrame:
    """C# auto properties of classes: type, setter, category and what a key or navigation points at."""
    rows = bodies(files).select("path", F.col("name").alias("entity"), F.posexplode(_zip(F.col("body"), _PROPERTY, {"type": 1, "name": 2, "s": 3})).alias("pos", "x")).select("path", "entity", "pos", "x.type", "x.name", "x.s")
    return _properties(rows).select("path", "entity", "name", "type", "setter", "category", "target", "is_collection")


def constructor_parameters(files: DataFrame) -> DataFrame:
    """(path, entity, param) of constructors."""
    made = F.regexp_extract_all("body", F.concat(F.lit(r"(?:public|internal|protected|private)\s+"), F.col("name"), F.lit(r"\s*\(([^)]*)\)")), F.lit(1))
    rows = bodies(files).select("path", F.col("name").alias("entity"), F.explode(made).alias("listed"))
    return rows.select("path", "entity", F.explode(F.split("listed", r",(?![^<]*>)")).alias("p")).select("path", "entity", F.regexp_extract("p", r"(\w+)\s*(?:=.*)?$", 1).alias("param")).where("param <> ''")


def attributes(files: DataFrame) -> DataFrame:
    """attributes on properties and classes with their rule."""
    rows = found(files, ".cs", r"\[(\w+)(?:\([^\]]*\))?\]\s*(?:\[[^\]]*\]\s*)*public\s+(?:virtual\s+|required\s+|sealed\s+)*[\w<>?\[\]]+\s+(\w+)", {"attribute": 1, "name": 2})
    return rows.withColumn("rule", _lookup(ATTRIBUTES, F.col("attribute"))).where("rule IS NOT NULL").select("path", "name", "attribute", "rule")


def guards(files: DataFrame) -> DataFrame:
    """F32: guarded parameters with the line of the call, rule and confidence; a line's first guard of each pattern."""
    lines = files.where(F.col("path").endswith(".cs")).select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(c).alias("confidence"), F.regexp_extract("line", p, 1).alias("param"))) for p, r, c in GUARDS]))
    return lines.select("path", (F.col("n") + 1).alias("line_no"), F.explode(hit).alias("h")).select("path", "line_no", "h.rule", "h.param", "h.confidence")


def repeated_guards(files: DataFrame, least: int = 3) -> DataFrame:
    """Guard rules in several entities (files), with how many."""
    return guards(files).groupBy("rule").agg(F.countDistinct("path").alias("n_entities")).where(F.col("n_entities") >= least)


def fluent(files: DataFrame) -> DataFrame:
    """configuration calls with the property that the same statement names."""
    rows = found(files, ".cs", r"\.(?:Property|HasIndex)\(\s*\w+\s*=>\s*\w+\.(\w+)\s*\)([^;]*);", {"name": 1, "calls": 2}).withColumn("calls", F.concat(F.lit("."), "calls"))
    index = found(files, ".cs", r"\.HasIndex\(\s*\w+\s*=>\s*\w+\.(\w+)\s*\)", {"name": 1}).select("path", "name", F.lit("index").alias("rule"))
    hit = F.array_compact(F.array(*[F.when(F.col("calls").rlike(p), F.lit(r)) for p, r in FLUENT]))
    return rows.select("path", "name", F.explode(hit).alias("rule")).union(index)


def configured(files: DataFrame) -> DataFrame:
    """Has/Owns lines of a configuration class for source; a With line among the next five turns the kind."""
    has = r"\b(HasMany|HasOne|OwnsOne|OwnsMany)\b"
    listed = files.where(F.col("path").endswith(".cs") & F.col("text").rlike(has)).select("path", F.regexp_extract("text", r"IEntityTypeConfiguration<(\w+)>", 1).alias("source"), F.split("text", "\n").alias("lines"))
    placed = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("n"), x.alias("line"))), lambda x: x["line"].rlike(has))
    many = lambda x: F.exists(F.slice("lines", x["n"] + 1, 6), lambda y: y.contains("WithMany"))
    hits = listed.select("path", "source", F.explode(F.transform(placed, lambda x: F.struct(x["n"].alias("n"), x["line"].alias("line"), many(x).alias("many")))).alias("x")).select("path", "source", "x.*")
    rows = hits.withColumns({"has": F.regexp_extract("line", has, 1), "via": F.regexp_extract("line", r"(?:HasMany|HasOne|OwnsOne|OwnsMany)\(\s*\w+\s*=>\s*\w+\.(\w+)", 1)})
    kind = F.when(F.col("has") == "OwnsOne", "owns_one").when(F.col("has") == "OwnsMany", "owns_many").when(F.col("has") == "HasMany", F.when(F.col("many"), "many_to_many").otherwise("one_to_many")).otherwise(F.when(F.col("many"), "many_to_one").otherwise("one_to_one"))
    return rows.select("path", "source", (F.col("n") + 1).alias("line_no"), "via", kind.alias("kind"))


def _class_facts(files: DataFrame) -> DataFrame:
    """path, cls (first class), auth and repositories of each C# file."""
    t = F.col("text")
    repos = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"I(?:Read)?Repository<(\w+)>"), F.lit(1)))), ",")
    return files.where(F.col("path").endswith(".cs")).select("path", "text", F.regexp_extract("text", r"(?:public|internal)\s+(?:partial\s+)?class\s+(\w+)", 1).alias("cls"), t.contains("[Authorize").alias("auth"), repos.alias("repos"))


def route(text: Column) -> tuple[Column, Column]:
    """(route, method) of the first MapX call; '/unknown' and GET where there is none."""
    method = F.upper(F.regexp_extract(text, r"\bMap(Get|Post|Put|Delete|Patch)\b", 1))
    path = F.regexp_extract(text, r"(?s)\bMap(?:Get|Post|Put|Delete|Patch)\b.{0,200}?\"([^\"]+)\"", 1)
    return F.when(path == "", "/unknown").otherwise(path), F.when(method == "", "GET").otherwise(method)


def endpoint_classes(files: DataFrame) -> DataFrame:
    """Classes derived from an endpoint base: route, method, request and response model, repositories, auth."""
    typed, chained = r"\bIEndpoint\s*<\s*IResult\s*,\s*(\w+)", r"\bEndpointBase(?:Async)?\.WithRequest<(\w+)>\.With(?:ActionResult|Response)<(\w+)>"
    path, method = route(F.col("text"))
    rows = _class_facts(files).where(F.col("text").rlike(f"{typed}|{chained}"))
    one = F.regexp_extract("text", typed, 1)
    request = F.when(one == "", F.regexp_extract("text", chained, 1)).otherwise(one)
    return rows.select("path", "cls", path.alias("route"), method.alias("method"), request.alias("request"), F.regexp_extract("text", chained, 2).alias("response"), "repos", "auth")


def controllers(files: DataFrame) -> DataFrame:
    """A row for each [HttpX] of a controller, with the file's first route or else its class."""
    rows = _class_facts(files).where(F.col("text").rlike(r":\s*(?:Controller|ControllerBase|ApiController)\b"))
    first = F.regexp_extract("text", r"\[Route\s*\(\s*[\"']([^\"']+)[\"']", 1)
    verbs = F.regexp_extract_all("text", F.lit(r"\[Http(Get|Post|Put|Delete|Patch)\s*(?:\([^)]*\))?\]"), F.lit(1))
    return rows.select("path", "cls", F.when(first == "", F.concat(F.lit("/"), "cls")).otherwise(first).alias("route"), F.explode(F.transform(verbs, F.upper)).alias("method"), "repos", "auth")


def handlers(files: DataFrame) -> DataFrame:
    """Mediator handlers with request, response ('void' without one) and repositories."""
    rows = _class_facts(files).select("path", "cls", "repos", F.explode(_zip(F.col("text"), r"IRequestHandler\s*<\s*(\w+)\s*(?:,\s*(\w+(?:<[^>]+>)?))?\s*>", {"a": 1, "b": 2})).alias("x"))
    return rows.select("path", "cls", F.col("x.a").alias("request"), F.when(_text("x.b") == "", "void").otherwise(F.col("x.b")).alias("response"), "repos")


def requests(files: DataFrame) -> DataFrame:
    """Classes and records that are mediator requests."""
    rows = found(files, ".cs", r"\b(?:class|record)\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*IRequest\b\s*(?:<\s*(\w+(?:<[^>]+>)?)\s*>)?", {"name": 1, "response": 2})
    return rows.select("path", "name", F.when(_text("response") == "", "void").otherwise(F.col("response")).alias("response"))


def dto_fields(files: DataFrame) -> DataFrame:
    """(path, dto, pos, name, type) of transfer objects: their properties, or a record's positional parameters."""
    ends = F.col("dto").rlike(f"(?i)(?:{DTO_ENDS})$")
    own = bodies(files.where(F.col("text").rlike("get|set|init"))).select("path", F.col("name").alias("dto"), F.posexplode(_zip(F.col("body"), r"(?:public|internal)\s+(?:required\s+)?([\w<>?, \[\]]+?)\s+(\w+)\s*\{\s*(?:get|set|init)", {"type": 1, "name": 2})).alias("pos", "x"))
    placed = found(files, ".cs", r"\brecord\s+(\w+)\s*\(([^)]*)\)", {"dto": 1, "listed": 2}).select("path", "dto", F.posexplode(F.split("listed", r",(?![^<]*>)")).alias("pos", "p"))
    placed = placed.select("path", "dto", "pos", F.regexp_extract("p", r"(\w+)\s*(?:=.*)?$", 1).alias("name"), F.trim(F.regexp_extract("p", r"^\s*(.+?)\s+\w+\s*(?:=.*)?$", 1)).alias("type")).where("name <> ''")
    return own.select("path", "dto", "pos", "x.name", "x.type").where(ends).union(placed.where(ends))


def enriched(endpoints: DataFrame, dtos: DataFrame) -> DataFrame:
    """Endpoints with the fields of their request model; of several definitions of a name, the last path's."""
    listed = dtos.groupBy("dto", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x.getField("name")), ",").alias("fields"))
    last = listed.groupBy("dto").agg(F.max_by("fields", "path").alias("request_fields"))
    return endpoints.join(last, endpoints["request"] == last["dto"], "left").select(*endpoints.columns, _text("request_fields").alias("request_fields"))


def page_handlers(files: DataFrame) -> DataFrame:
    """OnGet, OnPost... of page models."""
    rows = _class_facts(files).where(F.col("text").rlike(r":\s*PageModel\b"))
    hits = _zip(F.col("text"), r"public\s+(?:async\s+)?(?:Task<[^>]+>|Task|IActionResult|void)\s+On(Get|Post|Put|Delete)(\w*)\s*\(", {"m": 1, "s": 2})
    return rows.select("path", "cls", "repos", F.explode(hits).alias("x")).select("path", "cls", F.upper("x.m").alias("method"), F.regexp_replace(_text("x.s"), "Async$", "").alias("suffix"), "repos")


def mappings(files: DataFrame) -> DataFrame:
    """Source and destination of mapper profiles."""
    return found(files, ".cs", r"CreateMap\s*<\s*(\w+)\s*,\s*(\w+)\s*>", {"source": 1, "destination": 2}).select("path", "source", "destination")


# ---- routes of the other languages


def endpoints(files: DataFrame) -> DataFrame:
    """Method and route of minimal APIs, FastAPI, Flask (one row a method), view sets and Express."""
    cs = found(files, ".cs", r"\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]*)\"", {"m": 1, "route": 2})
    fast = found(files, ".py", r"@(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]*)['\"]", {"m": 1, "route": 2})
    flask = found(files, ".py", r"@\w+\.route\(\s*['\"]([^'\"]*)['\"](?:\s*,\s*methods\s*=\s*\[([^\]]*)\])?", {"route": 1, "m": 2})
    flask = flask.withColumn("m", F.explode(F.split(F.when(_text("m") == "", "GET").otherwise(F.regexp_replace("m", "['\" ]", "")), ",")))
    drf = found(files, ".py", r"(?m)^class\s+(\w+)\s*\([^)]*(?:ViewSet|APIView)[^)]*\)", {"route": 1}).withColumns({"m": F.lit("GET"), "route": F.concat(F.lit("/"), F.lower(F.regexp_replace("route", "(?:ViewSet|APIView|View)$", "")))})
    js = [found(files, s, r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"]([^'\"]*)['\"]", {"m": 1, "route": 2}) for s in (".ts", ".js")]
    out = None
    for rows, style in ((cs, "minimal_api"), (fast, "fastapi"), (flask, "flask"), (drf, "django_viewset"), (js[0], "express"), (js[1], "express")):
        part = rows.select("path", F.upper("m").alias("method"), "route", F.lit(style).alias("style"))
        out = part if out is None else out.union(part)
    return out


# ---- Java


def spring_endpoints(files: DataFrame) -> DataFrame:
    """Mapped methods joined to the class's base path, and whether the file asks for a role."""
    base = files.where(F.col("path").endswith(".java")).select("path", F.regexp_replace(F.regexp_extract("text", r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"", 1), "/$", "").alias("base"), F.col("text").rlike(r"@(?:PreAuthorize|Secured|RolesAllowed|Authorize)\b").alias("auth"))
    one = found(files, ".java", r"@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:value\s*=\s*)?\"([^\"]*)\"\s*\))?", {"m": 1, "route": 2})
    full = F.concat("base", F.when(_text("route") == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace("route", "^/", ""))))
    return one.join(base, "path").select("path", F.upper("m").alias("method"), F.when(full == "", "/").otherwise(full).alias("route"), "auth")


#: Annotations of types that are stored.
STORED = r"@(?:Entity|Embeddable|MappedSuperclass)\b"


def _stored(files: DataFrame, **more: Column) -> DataFrame:
    return scopes.java_types(files, **more).where(F.col("kind").isin("class", "record") & F.col("notes").rlike(STORED))


def jpa_entities(files: DataFrame) -> DataFrame:
    """Annotated classes, several a file and inner ones too, with package, base and interfaces; embeddable ones are value
    objects."""
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    kind = F.when(F.col("notes").rlike(r"\babstract\b"), "entity").when(F.col("notes").rlike(r"@(?:MappedSuperclass|Embeddable)\b"), "value_object").otherwise("entity")
    return _stored(files, package=package).withColumn("kind", kind).select("path", "package", F.col("name").alias("entity"), _text(F.try_element_at("parents", F.lit(1))).alias("base"), F.array_join("interfaces", ",").alias("interfaces"), "kind")


def _members(files: DataFrame) -> DataFrame:
    """(path, source, notes, type, name) of the fields of annotated classes; static ones are not stored."""
    return _stored(files).select("path", F.col("name").alias("source"), F.explode("fields").alias("f")).select("path", "source", "f.*")


def jpa_fields(files: DataFrame) -> DataFrame:
    """Fields of entities: type, key, kind, length and whether null is allowed, by the annotations before them."""
    notes = F.col("notes")
    base = F.trim(F.regexp_extract("type", r"^([\w\[\].]+)", 1))
    kind = F.when(notes.rlike(r"@Id\b"), "primitive").when(notes.rlike(r"@(?:OneToMany|ElementCollection)\b"), "collection").when(notes.rlike(r"@(?:ManyToOne|ManyToMany|OneToOne)\b"), "navigation").when(notes.rlike(r"@Embedded\b"), "embedded").otherwise("primitive")
    length = F.nullif(F.regexp_extract(notes, r"@Column\s*\([^)]*\blength\s*=\s*(\d+)", 1), F.lit("")).cast("int")
    return _members(files).select("path", "name", "type", _lookup(JAVA, base, F.lower(base)).alias("norm_type"), notes.rlike(r"@Id\b").alias("is_pk"), kind.alias("kind"), length.alias("max_length"), (~notes.rlike(r"nullable\s*=\s*false|@NotNull\b|@NonNull\b")).alias("is_nullable"), field_risk(F.col("name"), "java").alias("risk"))


def jpa_relations(files: DataFrame) -> DataFrame:
    """Annotated fields that point at another type; via is the join column, else the field."""
    note = F.regexp_extract("notes", r"@(OneToMany|ManyToOne|ManyToMany|OneToOne|Embedded|ElementCollection)\b", 1)
    target = F.regexp_replace(F.regexp_replace("type", r"^(?:List|Set|Collection|Optional)\s*<\s*(\w+)\s*>$", "$1"), "<.*$", "")
    join = F.regexp_extract("notes", r"@JoinColumn\s*\(\s*name\s*=\s*\"([^\"]*)\"", 1)
    out = _members(files).select("path", "source", target.alias("target"), _lookup(KINDS, note).alias("kind"), F.when(join == "", F.col("name")).otherwise(join).alias("via"))
    return out.where("kind IS NOT NULL AND target <> source AND length(target) > 1")


def jpa_repositories(files: DataFrame) -> DataFrame:
    """Repository interfaces with their entity."""
    known = r"^(?:JpaRepository|CrudRepository|PagingAndSortingRepository|Repository)<(\w+)"
    rows = scopes.java_types(files).where("kind = 'interface'").select("path", F.col("name").alias("repo"), F.try_element_at(F.filter("parents", lambda p: p.rlike(known)), F.lit(1)).alias("p"))
    return rows.where("p IS NOT NULL").select("path", "repo", F.regexp_extract("p", known, 1).alias("entity"))


# ---- Python


def _python_classes(files: DataFrame, base: str) -> DataFrame:
    return found(files, ".py", rf"(?ms)^class\s+(\w+)\s*\((?:{base})[^)]*\)\s*:(.*?)(?=^\S|\z)", {"entity": 1, "body": 2})


def django_fields(files: DataFrame) -> DataFrame:
    """Model fields with type, length, null and key; relations with their target."""
    body = _python_classes(files, r"models\.Model").select("path", "entity", F.posexplode(_zip(F.col("body"), r"(?m)^\s{4}(\w+)\s*=\s*models\.(\w+)\(([^\n]*)\)", {"name": 1, "field": 2, "args": 3})).alias("pos", "x"))
    rows = body.select("path", "entity", "x.name", "x.field", "x.args")
    rel = F.when(F.col("field") == "ForeignKey", "many_to_one").when(F.col("field") == "OneToOneField", "one_to_one").when(F.col("field") == "ManyToManyField", "many_to_many")
    length = F.nullif(F.regexp_extract("args", r"\bmax_length\s*=\s*(\d+)", 1), F.lit("")).cast("int")
    return rows.select("path", "entity", "name", _lookup(DJANGO, F.col("field"), F.lower("field")).alias("type"), rel.alias("kind"), F.when(rel.isNotNull(), F.regexp_extract("args", r"^['\"]?(\w+)", 1)).alias("target"), length.alias("max_length"), F.col("args").rlike(r"\b(?:null|blank)\s*=\s*True").alias("nullable"), F.col("args").rlike(r"\bprimary_key\s*=\s*True").alias("is_pk"), field_risk(F.col("name"), "python").alias("risk"))


def sqlalchemy_fields(files: DataFrame) -> DataFrame:
    """Columns of declarative models, private names left out; String without a known type."""
    body = _python_classes(files, r"Base|DeclarativeBase|db\.Model").select("path", "entity", F.posexplode(_zip(F.col("body"), r"(?m)^\s{4}(\w+)\s*(?::\s*[\w\[\]|. ]+)?\s*=\s*(?:\w+\.)?(?:mapped_column|Column)\s*\(((?:[^()]|\([^()]*\))*)\)", {"name": 1, "args": 2})).alias("pos", "x"))
    rows = body.select("path", "entity", "x.name", "x.args").where("name NOT LIKE '\\\\_%'")
    kind = F.regexp_extract("args", r"\b(String|Integer|Float|Boolean|DateTime|Date|UUID|Text|Numeric|LargeBinary)\b", 1)
    kind = F.when(kind == "", "String").otherwise(kind)
    types = {"String": "string", "Integer": "integer", "Float": "decimal", "Boolean": "boolean", "DateTime": "datetime", "Date": "datetime", "UUID": "uuid", "Text": "text", "Numeric": "numeric", "LargeBinary": "largebinary"}
    length = F.nullif(F.regexp_extract("args", r"\bString\s*\((\d+)\)", 1), F.lit("")).cast("int")
    return rows.select("path", "entity", "name", kind.alias("raw_type"), _lookup(types, kind).alias("type"), length.alias("max_length"), F.col("args").contains("primary_key=True").alias("is_pk"), (~F.col("args").contains("nullable=False")).alias("nullable"), field_risk(F.col("name"), "python").alias("risk"))


def sqlalchemy_relations(files: DataFrame) -> DataFrame:
    """relationship() attributes."""
    body = _python_classes(files, r"Base|DeclarativeBase|db\.Model")
    rows = body.select("path", F.col("entity").alias("source"), F.explode(_zip(F.col("body"), r"(?m)^\s{4}(\w+)\s*(?::[^=\n]*)?=\s*(?:\w+\.)?relationship\s*\(\s*['\"](\w+)['\"]", {"via": 1, "target": 2})).alias("x"))
    return rows.select("path", "source", F.col("x.target").alias("target"), F.lit("one_to_many").alias("kind"), F.col("x.via").alias("via"))


# ---- Node


def _node(name: Column, raw: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(raw, r"\s*\|\s*null", ""), r"[\[\]?]+$", "")
    return _lookup(NODE, base, F.lower(base))


def prisma_fields(files: DataFrame) -> DataFrame:
    """Fields of Prisma models; a type that is another model makes a relation."""
    models = found(files, ".prisma", r"(?ms)^model\s+(\w+)\s*\{(.*?)^\}", {"model": 1, "body": 2})
    lines = models.select("path", "model", F.explode(_zip(F.col("body"), r"(?m)^\s+(\w+)\s+(\w+)(\[\])?(\?)?([^\n]*)$", {"name": 1, "type": 2, "many": 3, "opt": 4, "rest": 5})).alias("x")).select("path", "model", "x.*")
    known = models.select(F.col("model").alias("type"), F.lit(True).alias("is_model")).distinct()
    rows = lines.join(known, "type", "left").withColumn("is_list", _text("many") != "")
    scalar = F.col("type").isin("Int", "String", "Boolean", "Float", "DateTime", "Decimal", "BigInt", "Bytes", "Json")
    kind = F.when(~scalar & F.col("type").rlike("^[A-Z]"), F.when(F.col("is_list"), "one_to_many").otherwise("many_to_one"))
    return rows.select("path", "model", "name", "type", "is_list", (_text("opt") != "").alias("nullable"), F.col("rest").rlike(r"@id\b").alias("is_pk"), kind.alias("kind"), field_risk(F.col("name"), "node").alias("risk"))


def typeorm_fields(files: DataFrame) -> DataFrame:
    """Columns of TypeORM entities."""
    classes_ = found(files, ".ts", r"(?ms)@Entity\s*\([^)]*\)\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{(.*?)^\}", {"entity": 1, "body": 2})
    rows = classes_.select("path", "entity", F.explode(_zip(F.col("body"), r"@(Column|PrimaryColumn|PrimaryGeneratedColumn|CreateDateColumn|UpdateDateColumn)\s*(?:\([^)]*\))?\s+(\w+)\s*([!?])?\s*:\s*([\w<>\[\] |]+)", {"note": 1, "name": 2, "mark": 3, "type": 4})).alias("x")).select("path", "entity", "x.*")
    raw = F.trim("type")
    return rows.select("path", "entity", "name", raw.alias("raw_type"), _node(F.col("name"), raw).alias("type"), F.col("note").startswith("Primary").alias("is_pk"), ((_text("mark") == "?") | raw.contains("| null")).alias("nullable"), field_risk(F.col("name"), "node").alias("risk"))


def typeorm_relations(files: DataFrame) -> DataFrame:
    """Relation decorators of TypeORM entities with the property that they stand on."""
    classes_ = found(files, ".ts", r"(?ms)@Entity\s*\([^)]*\)\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)[^{]*\{(.*?)^\}", {"source": 1, "body": 2})
    rows = classes_.select("path", "source", F.explode(_zip(F.col("body"), r"(?m)@(OneToMany|ManyToOne|ManyToMany|OneToOne)\s*\(\s*(?:\w+|\([^)]*\))\s*=>\s*(\w+)[^\n]*\n(?:\s*@[^\n]*\n)*\s*(\w+)", {"note": 1, "target": 2, "via": 3})).alias("x"))
    return rows.select("path", "source", F.col("x.target").alias("target"), _lookup(KINDS, F.col("x.note")).alias("kind"), F.col("x.via").alias("via"))


def mongoose_fields(files: DataFrame) -> DataFrame:
    """Fields of Mongoose schemas; the model's name is the schema's without 'Schema'."""
    schemas = found(files, ".js", r"(?ms)\b(?:const|let|var)\s+(\w+)Schema\s*=\s*new\s+(?:mongoose\.)?Schema\s*\(\s*\{(.*?)^\}", {"entity": 1, "body": 2})
    rows = schemas.select("path", "entity", F.explode(_zip(F.col("body"), r"(?m)^\s{2,4}(\w+)\s*:\s*\{([^}]*\btype\s*:\s*(\w+)[^}]*)\}", {"name": 1, "args": 2, "type": 3})).alias("x")).select("path", "entity", "x.*")
    return rows.select("path", "entity", "name", F.col("type").alias("raw_type"), _node(F.col("name"), F.col("type")).alias("type"), (~F.col("args").rlike(r"required\s*:\s*true")).alias("nullable"), field_risk(F.col("name"), "node").alias("risk"))


def sequelize_fields(files: DataFrame) -> DataFrame:
    """Fields of Sequelize models, by class and init or by define."""
    made = found(files, ".ts", r"(?ms)\bclass\s+(\w+)\s+extends\s+Model\b.*?\.init\s*\(\s*\{(.*?)^\}", {"entity": 1, "body": 2}).union(found(files, ".js", r"(?ms)\b(?:sequelize|db)\.define\s*\(\s*['\"](\w+)['\"]\s*,\s*\{(.*?)^\}", {"entity": 1, "body": 2}))
    rows = made.select("path", "entity", F.explode(_zip(F.col("body"), r"(\w+)\s*:\s*\{([^}]*\btype\s*:\s*DataTypes\.(\w+)[^}]*)\}", {"name": 1, "args": 2, "type": 3})).alias("x")).select("path", "entity", "x.*")
    return rows.select("path", "entity", "name", F.concat(F.lit("DataTypes."), "type").alias("raw_type"), _node(F.col("name"), F.col("type")).alias("type"), (~F.col("args").rlike(r"allowNull\s*:\s*false")).alias("nullable"), F.col("args").rlike(r"primaryKey\s*:\s*true").alias("is_pk"), field_risk(F.col("name"), "node").alias("risk"))
