"""Queries over source text. Each part row gives one file of each kind, named after its key, with the rows that it means."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import code as C
from metaloom.plans.registry import add, per_part

FILES = [
    ("Api~k~.cs", 'app.MapGet("/orders~k~", H);\napp.MapPost( "/orders~k~", H2);'),
    ("Order~k~.cs", """using System;
namespace Shop.Orders~k~;

public class Order~k~ : Entity, IAggregateRoot {
  [Key] public int Id { get; private set; }
  [MaxLength(20)] public string Name { get; set; }
  public int BuyerId { get; set; }
  public Address? Home { get; init; }
  public List<Line~k~> Lines { get; }
  public List<int> Codes { get; set; }
  public Order~k~(string name, int n = 3) {
    Guard.Against.NullOrEmpty(name, nameof(name));
    Guard.Against.NegativeOrZero(n);
    if (string.IsNullOrEmpty(name)) throw new ArgumentNullException(nameof(name));
  }
}
public record Money~k~(decimal Amount, string Unit);
internal class Line~k~ { }
"""),
    ("Config~k~.cs", "class C~k~ : IEntityTypeConfiguration<Order~k~> { } b.Property(o => o.Name~k~).IsRequired().HasMaxLength(20);\nb.HasMany(o => o.Lines)\n .WithOne(l => l.Order);\n\n\n\n\n\n\nb.HasOne(o => o.Customer)\n .WithMany();\nb.OwnsOne(o => o.Home);\nb.HasIndex(o => o.Code~k~).IsUnique();\n"),
    ("Create~k~.cs", """namespace Shop.Api;
[Authorize]
public class CreateEndpoint~k~ : IEndpoint<IResult, CreateRequest~k~, IRepository<Order~k~>> {
  public void AddRoute(IEndpointRouteBuilder app) { app.MapPost("/create/~k~", H); }
}
public class CreateRequest~k~Dto {
  public string Name { get; set; }
  public int? Count { get; init; }
}
public record CreateQuery(int A~k~, List<string> B);
"""),
    ("Bare~k~.cs", "public class BareEndpoint~k~ : EndpointBase.WithRequest<CreateQuery>.WithResponse<Out~k~> { IReadRepository<Item> a; IRepository<Cart> b; }"),
    ("Ctl~k~.cs", 'public class Ctl~k~ : ControllerBase {\n  [HttpGet("x")] public void A() {}\n  [HttpDelete] public void B() {}\n}'),
    ("Handle~k~.cs", "public class Handle~k~ : IRequestHandler<Ask~k~, List<int>> { IRepository<Order> r; }\npublic record Ask~k~(int Id) : IRequest<int>;\npublic class Ping~k~ : IRequest { }\nclass M { void C() { CreateMap<Order~k~, OrderDto>(); } }"),
    ("Page~k~.cs", "public class Page~k~ : PageModel {\n  public async Task<IActionResult> OnPostSaveAsync() {}\n  public void OnGet() {}\n}"),
    ("api~k~.py", "@app.get('/a~k~')\ndef a(): ...\n@bp.route('/b', methods=['GET', 'POST'])\ndef b(): ...\n@bp.route('/c')\ndef c(): ...\nclass Thing~k~ViewSet(viewsets.ModelViewSet):\n    pass\n"),
    ("models~k~.py", "class Order~k~(models.Model):\n    id = models.AutoField(primary_key=True)\n    email = models.CharField(max_length=20, null=True)\n    owner = models.ForeignKey('User~k~', on_delete=models.CASCADE)\n    tags = models.ManyToManyField(Tag)\n\nclass Plain:\n    x = models.CharField()\n"),
    ("sa~k~.py", "class User~k~(Base):\n    __tablename__ = 'u'\n    id = Column(Integer, primary_key=True)\n    name: Mapped[str] = mapped_column(String(40), nullable=False)\n    _x = Column(Integer)\n    posts = relationship('Post~k~', back_populates='u')\n"),
    ("app~k~.ts", "router.get('/x~k~', h); app.delete(\"/y\", h)"),
    ("orm~k~.ts", "@Entity('t')\nexport class Cat~k~ {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ length: 10 })\n  name?: string;\n  @ManyToOne(() => Owner~k~, o => o.cats)\n  owner: Owner~k~;\n}\nclass Seq~k~ extends Model<A, B> {}\nSeq~k~.init({\n  code: { type: DataTypes.TEXT, allowNull: false },\n  n: { type: DataTypes.INTEGER, primaryKey: true },\n}, {});\n"),
    ("schema~k~.js", "const Person~k~Schema = new mongoose.Schema({\n  email: { type: String, required: true },\n  age: { type: Number },\n});\nsequelize.define('Def~k~', {\n  flag: { type: DataTypes.BOOLEAN },\n});\n"),
    ("Ctl~k~.java", '@RequestMapping("/api")\n@PreAuthorize("x")\nclass Ctl {\n @GetMapping("/o~k~") Object o() {}\n @PostMapping Object p() {} }'),
    ("Ent~k~.java", """package a.b;
@Entity
public class Ent~k~ extends Base implements Serializable, Cloneable {
  @Id @Column(name = "i")
  private Long id;
  @Column(length = 30, nullable = false) private String email;
  @OneToMany(mappedBy = "e")
  private List<Item~k~> items;
  @ManyToOne @JoinColumn(name = "own_id")
  private Owner owner;
}
interface EntRepo~k~ extends JpaRepository<Ent~k~, Long> {}
"""),
    ("s~k~.prisma", "model User~k~ {\n  id Int @id\n  name String?\n  posts Post[]\n}\n"),
]


def part_keys(s, d):
    """(k) of the parts, dealt over tasks: a small file is one task's, the files made of its rows are not."""
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey").repartition(4 * s.sparkContext.defaultParallelism, "p_partkey").select(F.col("p_partkey").alias("k"))


def files(s, d):
    # A join, so that Spark knows how much it makes of the keys and joins by shuffles what follows from them.
    template = F.broadcast(s.createDataFrame(FILES, "p string, t string"))
    made = part_keys(s, d).select(F.col("k").cast("string").alias("k")).crossJoin(template)
    return made.select(F.replace("p", F.lit("~k~"), "k").alias("path"), F.replace("t", F.lit("~k~"), "k").alias("text"))


def check(name, operator, schema, rows):
    add(name, lambda s, d: operator(files(s, d)).select(*[c.strip() for c in schema.split(",")]), per_part(schema, rows))


A, O, G, H = "Api~k~.cs", "Order~k~.cs", "Config~k~.cs", "Handle~k~.cs"
check("P28_P34_endpoints", C.endpoints, "path, method, route, style", [(A, "GET", "/orders~k~", "minimal_api"), (A, "POST", "/orders~k~", "minimal_api"), ("Create~k~.cs", "POST", "/create/~k~", "minimal_api"), ("api~k~.py", "GET", "/a~k~", "fastapi"), ("api~k~.py", "GET", "/b", "flask"), ("api~k~.py", "POST", "/b", "flask"), ("api~k~.py", "GET", "/c", "flask"), ("api~k~.py", "GET", "/thing~k~", "django_viewset"), ("app~k~.ts", "GET", "/x~k~", "express"), ("app~k~.ts", "DELETE", "/y", "express")])
check("P28_P29_endpoint_classes", C.endpoint_classes, "path, cls, route, method, request, response, repos, auth", [("Create~k~.cs", "CreateEndpoint~k~", "/create/~k~", "POST", "CreateRequest~k~", "", "Order~k~", True), ("Bare~k~.cs", "BareEndpoint~k~", "/unknown", "GET", "CreateQuery", "Out~k~", "Cart,Item", False)])
check("P28_controllers", C.controllers, "path, cls, route, method, repos, auth", [("Ctl~k~.cs", "Ctl~k~", "/Ctl~k~", "GET", "", False), ("Ctl~k~.cs", "Ctl~k~", "/Ctl~k~", "DELETE", "", False)])
check("P28_handlers", C.handlers, "path, cls, request, response, repos", [(H, "Handle~k~", "Ask~k~", "List<int>", "Order")])
check("P28_requests", C.requests, "path, name, response", [(H, "Ask~k~", "int"), (H, "Ping~k~", "void")])
check("P28_P30_dto_fields", C.dto_fields, "path, dto, pos, name, type", [("Create~k~.cs", "CreateRequest~k~Dto", 0, "Name", "string"), ("Create~k~.cs", "CreateRequest~k~Dto", 1, "Count", "int?"), ("Create~k~.cs", "CreateQuery", 0, "A~k~", "int"), ("Create~k~.cs", "CreateQuery", 1, "B", "List<string>")])
add("P31_request_fields", lambda s, d: C.enriched(C.endpoint_classes(files(s, d)), C.dto_fields(files(s, d))).select("cls", "request", "request_fields"), "WITH l AS (SELECT max('Create' || p_partkey || '.cs') AS f FROM part) SELECT 'BareEndpoint' || p_partkey AS cls, 'CreateQuery' AS request, 'A' || regexp_extract(f, '[0-9]+') || ',B' AS request_fields FROM part, l UNION ALL SELECT 'CreateEndpoint' || p_partkey, 'CreateRequest' || p_partkey, '' FROM part")
check("P28_page_handlers", C.page_handlers, "path, cls, method, suffix", [("Page~k~.cs", "Page~k~", "POST", "Save"), ("Page~k~.cs", "Page~k~", "GET", "")])
check("P28_mappings", C.mappings, "path, source, destination", [(H, "Order~k~", "OrderDto")])
check("P35_spring_endpoints", C.spring_endpoints, "path, method, route, auth", [("Ctl~k~.java", "GET", "/api/o~k~", True), ("Ctl~k~.java", "POST", "/api", True)])
check("P35_entities", C.jpa_entities, "path, package, entity, base, interfaces, kind", [("Ent~k~.java", "a.b", "Ent~k~", "Base", "Serializable,Cloneable", "entity")])
check("P35_X04_fields", C.jpa_fields, "path, name, type, norm_type, is_pk, kind, max_length, is_nullable, risk", [("Ent~k~.java", "id", "Long", "integer", True, "primitive", None, True, None), ("Ent~k~.java", "email", "String", "string", False, "primitive", 30, False, "medium"), ("Ent~k~.java", "items", "List<Item~k~>", "list", False, "collection", None, True, None), ("Ent~k~.java", "owner", "Owner", "owner", False, "navigation", None, True, None)])
check("P35_relations", C.jpa_relations, "path, source, target, kind, via", [("Ent~k~.java", "Ent~k~", "Item~k~", "one_to_many", "items"), ("Ent~k~.java", "Ent~k~", "Owner", "many_to_one", "own_id")])
check("P35_repositories", C.jpa_repositories, "path, repo, entity", [("Ent~k~.java", "EntRepo~k~", "Ent~k~")])
check("P26_P38_classes", C.classes, "path, ns, name, kind, bases, interfaces, is_root, is_value", [(O, "Shop.Orders~k~", "Order~k~", "class", "Entity", "IAggregateRoot", True, False), (O, "Shop.Orders~k~", "Money~k~", "record", "", "", False, True), (O, "Shop.Orders~k~", "Line~k~", "class", "", "", False, False), (G, "", "C~k~", "class", "", "IEntityTypeConfiguration<Order~k~>", False, False), ("Create~k~.cs", "Shop.Api", "CreateQuery", "record", "", "", False, True), ("Create~k~.cs", "Shop.Api", "CreateRequest~k~Dto", "class", "", "", False, False), ("Create~k~.cs", "Shop.Api", "CreateEndpoint~k~", "class", "", "IEndpoint<IResult,CreateRequest~k~,IRepository<Order~k~>>", False, False), ("Bare~k~.cs", "", "BareEndpoint~k~", "class", "EndpointBase.WithRequest<CreateQuery>.WithResponse<Out~k~>", "", False, False), ("Ctl~k~.cs", "", "Ctl~k~", "class", "ControllerBase", "", False, False), (H, "", "M", "class", "", "", False, False), (H, "", "Ping~k~", "class", "", "IRequest", False, False), (H, "", "Ask~k~", "record", "", "IRequest<int>", False, True), (H, "", "Handle~k~", "class", "", "IRequestHandler<Ask~k~,List<int>>", False, False), ("Page~k~.cs", "", "Page~k~", "class", "PageModel", "", False, False)])
check("P38_symbols", C.symbols, "path, kind, name", [(O, "using", "System"), (O, "namespace", "Shop.Orders~k~"), ("Create~k~.cs", "namespace", "Shop.Api")])
check("P26_P30_properties", C.properties, "path, entity, name, type, setter, category, target, is_collection", [(O, "Order~k~", "Id", "int", "private", "primitive", "", False), (O, "Order~k~", "Name", "string", "public", "primitive", "", False), (O, "Order~k~", "BuyerId", "int", "public", "foreign_key", "Buyer", False), (O, "Order~k~", "Home", "Address?", "init", "navigation", "Address", False), (O, "Order~k~", "Lines", "List<Line~k~>", "none", "collection", "Line~k~", True), (O, "Order~k~", "Codes", "List<int>", "public", "primitive", "", True), ("Create~k~.cs", "CreateRequest~k~Dto", "Name", "string", "public", "primitive", "", False), ("Create~k~.cs", "CreateRequest~k~Dto", "Count", "int?", "init", "primitive", "", False)])
check("P26_constructor_parameters", C.constructor_parameters, "path, entity, param", [(O, "Order~k~", "name"), (O, "Order~k~", "n")])
check("F31_attributes", C.attributes, "path, name, attribute, rule", [(O, "Id", "Key", "primary_key"), (O, "Name", "MaxLength", "max_length")])
check("F32_guards", C.guards, "path, line_no, rule, param, confidence", [(O, 12, "not_null", "name", "HIGH"), (O, 13, "positive_value", "n", "HIGH"), (O, 14, "not_null", "name", "MEDIUM"), (O, 14, "not_null", "name", "MEDIUM")])
add("A14_repeated_guards", lambda s, d: C.repeated_guards(files(s, d)), "SELECT rule, count(*) AS n_entities FROM part, (VALUES ('not_null'), ('positive_value')) AS r(rule) GROUP BY rule HAVING count(*) >= 3")
check("F33_fluent", C.fluent, "path, name, rule", [(G, "Name~k~", "not_null"), (G, "Name~k~", "max_length"), (G, "Code~k~", "index"), (G, "Code~k~", "unique")])
check("P24_W06_configured", C.configured, "path, source, line_no, via, kind", [(G, "Order~k~", 2, "Lines", "one_to_many"), (G, "Order~k~", 10, "Customer", "many_to_one"), (G, "Order~k~", 12, "Home", "owns_one")])
check("P32_X04_django_fields", C.django_fields, "path, entity, name, type, kind, target, max_length, nullable, is_pk, risk", [("models~k~.py", "Order~k~", "id", "integer", None, None, None, False, True, None), ("models~k~.py", "Order~k~", "email", "string", None, None, 20, True, False, "medium"), ("models~k~.py", "Order~k~", "owner", "foreign_key", "many_to_one", "User~k~", None, False, False, None), ("models~k~.py", "Order~k~", "tags", "many_to_many", "many_to_many", "Tag", None, False, False, None)])
check("P33_sqlalchemy_fields", C.sqlalchemy_fields, "path, entity, name, raw_type, type, max_length, is_pk, nullable, risk", [("sa~k~.py", "User~k~", "id", "Integer", "integer", None, True, True, None), ("sa~k~.py", "User~k~", "name", "String", "string", 40, False, False, "low")])
check("P33_sqlalchemy_relations", C.sqlalchemy_relations, "path, source, target, kind, via", [("sa~k~.py", "User~k~", "Post~k~", "one_to_many", "posts")])
check("P36_prisma_fields", C.prisma_fields, "path, model, name, type, is_list, nullable, is_pk, kind, risk", [("s~k~.prisma", "User~k~", "id", "Int", False, False, True, None, None), ("s~k~.prisma", "User~k~", "name", "String", False, True, False, None, "low"), ("s~k~.prisma", "User~k~", "posts", "Post", True, False, False, "one_to_many", None)])
check("P36_typeorm_fields", C.typeorm_fields, "path, entity, name, raw_type, type, is_pk, nullable, risk", [("orm~k~.ts", "Cat~k~", "id", "number", "decimal", True, False, None), ("orm~k~.ts", "Cat~k~", "name", "string", "string", False, True, "low")])
check("P36_typeorm_relations", C.typeorm_relations, "path, source, target, kind, via", [("orm~k~.ts", "Cat~k~", "Owner~k~", "many_to_one", "owner")])
check("P36_mongoose_fields", C.mongoose_fields, "path, entity, name, raw_type, type, nullable, risk", [("schema~k~.js", "Person~k~", "email", "String", "string", False, "medium"), ("schema~k~.js", "Person~k~", "age", "Number", "decimal", True, None)])
check("P36_sequelize_fields", C.sequelize_fields, "path, entity, name, raw_type, type, nullable, is_pk, risk", [("orm~k~.ts", "Seq~k~", "code", "DataTypes.TEXT", "string", False, False, None), ("orm~k~.ts", "Seq~k~", "n", "DataTypes.INTEGER", "integer", True, True, None), ("schema~k~.js", "Def~k~", "flag", "DataTypes.BOOLEAN", "boolean", True, False, None)])
add("pages_links", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n")), "SELECT route, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS route FROM pages) GROUP BY route")
add("documents_words", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).cast("long").alias("n")), r"SELECT doc_id, len(regexp_extract_all(text, '\w+')) AS n FROM documents")
add("documents_mails", lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
#: Java files with inner types, annotations with braces, literals and comments that look like code; every second part's is on one line.
_JAVA = """package shop.p~k~;
/* @Entity class Gone~k~ { private int x; } */
@Entity @Table(name = "t{", indexes = {@Index(columnList = "a")})
public class Whole~k~<T extends Comparable<T>> extends Base<T> implements Marked<T>, Kept {
  private static final long serialVersionUID = 1L;
  @Id private Long id;
  @Column(name = "}", length = ~k~1) private String email = "private int no;";
  @OneToMany(mappedBy = "o", cascade = {CascadeType.ALL}) private List<Piece~k~> pieces;
  @Embedded private Place~k~ place;
  public String getEmail() { String s = "}"; return s; }
  @Embeddable public static class Place~k~ { @Column(nullable = false) private String city; }
  public static class Plain~k~ { private int unseen; }
  private int last;
}
@Entity class Piece~k~ { @ManyToOne @JoinColumn(name = "whole_id") private Whole~k~ whole; }
interface Pieces~k~ extends Marker, CrudRepository<Piece~k~, Long> { }
"""
J = "J~k~.java"


def java_files(s, d):
    text = F.replace("t", F.lit("~k~"), F.col("k").cast("string"))
    flat = F.regexp_replace(text, r"\s+", " ")
    made = part_keys(s, d).crossJoin(F.broadcast(s.createDataFrame([(_JAVA,)], "t string")))
    return made.select(F.concat(F.lit("J"), "k", F.lit(".java")).alias("path"), F.when(F.col("k") % 2 == 0, text).otherwise(flat).alias("text"))


def check_java(name, operator, schema, rows):
    add(name, lambda s, d: operator(java_files(s, d)).select(*[c.strip() for c in schema.split(",")]), per_part(schema, rows))


check_java("P35_inner_entities", C.jpa_entities, "path, package, entity, base, interfaces, kind", [(J, "shop.p~k~", "Whole~k~", "Base<T>", "Marked<T>,Kept", "entity"), (J, "shop.p~k~", "Place~k~", "", "", "value_object"), (J, "shop.p~k~", "Piece~k~", "", "", "entity")])
check_java("P35_inner_fields", C.jpa_fields, "path, name, type, is_pk, kind, is_nullable", [(J, "id", "Long", True, "primitive", True), (J, "email", "String", False, "primitive", True), (J, "pieces", "List<Piece~k~>", False, "collection", True), (J, "place", "Place~k~", False, "embedded", True), (J, "last", "int", False, "primitive", True), (J, "city", "String", False, "primitive", False), (J, "whole", "Whole~k~", False, "navigation", True)])
check_java("P35_inner_relations", C.jpa_relations, "path, source, target, kind, via", [(J, "Whole~k~", "Piece~k~", "one_to_many", "pieces"), (J, "Whole~k~", "Place~k~", "embeds", "place"), (J, "Piece~k~", "Whole~k~", "many_to_one", "whole_id")])
check_java("P35_inner_repositories", C.jpa_repositories, "path, repo, entity", [(J, "Pieces~k~", "Piece~k~")])
