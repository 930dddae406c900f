"""Queries of model checks and stack detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import model_checks as M
from metaloom.operators import stack as T
from metaloom.operators.signals import rule_hits
from metaloom.plans.fixtures import CATALOGS, cte, frame
from metaloom.plans.registry import add, for_suppliers, per_supplier, values

ents, fields, rels, eps, repos, hands, steps, files = ((lambda n: (lambda s, d: frame(s, d, n)))(n) for n in ("fx_entities", "fx_fields", "fx_rels", "fx_endpoints", "fx_repos", "fx_handlers", "fx_steps", "fx_files"))
CATALOGS["fx_kinds"] = ("kind string", [("fk",), ("read",), ("write",), ("delete",)])
add("V01_orphaned_keys", lambda s, d: M.orphaned_keys(fields(s, d), ents(s, d)), f"{cte('fx_fields', 'fx_entities')} SELECT entity, field, regexp_extract(field, '^(.+)Id$', 1) AS target FROM fx_fields WHERE NOT is_nav AND regexp_matches(field, '^.+Id$') AND regexp_extract(field, '^(.+)Id$', 1) NOT IN ('Card', 'AspNetUser', 'IdentityUser') AND regexp_extract(field, '^(.+)Id$', 1) NOT IN (SELECT entity FROM fx_entities)")
add("V03_unresolved", lambda s, d: M.unresolved_targets(rels(s, d), ents(s, d)), f"{cte('fx_rels', 'fx_entities')} SELECT source, target, via FROM fx_rels WHERE target NOT IN ('Card', 'AspNetUser', 'IdentityUser') AND target NOT IN (SELECT entity FROM fx_entities)")
add("V05_circular_dependencies", lambda s, d: M.circular_dependencies(rels(s, d)), f"""{cte('fx_rels')}, e AS (SELECT DISTINCT source AS src, target AS dst FROM fx_rels WHERE kind IN ('many_to_one', 'one_to_many', 'references') AND source <> target), p(path, last) AS (SELECT [src], dst FROM e WHERE src <= dst UNION ALL SELECT list_append(path, last), e.dst FROM p JOIN e ON e.src = p.last WHERE last > path[1] AND NOT list_contains(path, last))
  SELECT 'circular_dependency' AS "check", 'WARNING' AS severity, array_to_string(path, '→') AS cycle, CAST(len(path) AS INTEGER) AS length FROM p WHERE last = path[1]""")
add("V02_missing_navigation", lambda s, d: M.missing_navigation(fields(s, d), ents(s, d)), f"{cte('fx_fields', 'fx_entities')}, k AS (SELECT entity, field, regexp_extract(field, '^(.+)Id$', 1) AS target FROM fx_fields WHERE NOT is_nav AND regexp_matches(field, '^(.+)Id$')) SELECT * FROM k WHERE target IN (SELECT entity FROM fx_entities) AND NOT EXISTS (SELECT 1 FROM fx_fields n WHERE n.is_nav AND n.entity = k.entity AND n.type = k.target)")
add("V04_U04_lineage_gaps", lambda s, d: M.lineage_gaps(ents(s, d), steps(s, d)), f"{cte('fx_entities', 'fx_steps')} SELECT entity FROM fx_entities EXCEPT SELECT component FROM fx_steps WHERE layer = 'entity'")
CATALOGS["fx_twice"] = ("entity string, aggregate string", [("Order", "Order"), ("Order", "Archive"), ("Money", None), ("Money", "root"), ("Line", "Order"), ("Line", "Order"), ("Tag", None), ("Tag", "Crm")])
add("V06_name_conflicts", lambda s, d: M.name_conflicts(frame(s, d, "fx_twice")), f"{cte('fx_twice')} SELECT entity, count(DISTINCT coalesce(aggregate, 'root')) AS n FROM fx_twice GROUP BY entity HAVING count(DISTINCT coalesce(aggregate, 'root')) > 1")
CATALOGS["fx_found"] = ("entity string, field string, rule string", [("Customer", "Email", "pii"), ("Customer", "Password", "credential"), ("Customer", "Password", "encryption"), ("Card", "Number", "pci_dss"), ("Card", "Number", "sensitive_data"), ("Card", "Cvv", "pci_dss"), ("Card", "Cvv", "not_null"), ("Order", "Id", "primary_key")])
add("V07_unencrypted", lambda s, d: M.unencrypted(frame(s, d, "fx_found")), f"{cte('fx_found')} SELECT entity, field FROM fx_found WHERE rule IN ('pii', 'pci_dss', 'credential') EXCEPT SELECT entity, field FROM fx_found WHERE rule IN ('encryption', 'sensitive_data')")
D01 = "SELECT e.entity, coalesce((SELECT string_agg(field, ',' ORDER BY field) FROM fx_fields f WHERE f.entity = e.entity AND is_nav AND getter = 'public' AND setter IN ('public', 'none') AND type LIKE 'List%'), '') AS exposed, coalesce((SELECT sum(guards) FROM fx_handlers h WHERE list_contains(string_split(h.entities, ','), e.entity)), 0) > 0 AS guarded FROM fx_entities e WHERE kind = 'aggregate_root'"
D02 = "SELECT e.entity, coalesce(bool_or(lower(field) = 'id'), FALSE) AS has_id, coalesce(bool_or(setter IN ('public', 'internal')), FALSE) AS has_setter, CAST(coalesce(bool_or(lower(field) = 'id'), FALSE) AS INTEGER) + CAST(coalesce(bool_or(setter IN ('public', 'internal')), FALSE) AS INTEGER) AS n_issues FROM fx_entities e LEFT JOIN fx_fields f ON f.entity = e.entity WHERE kind = 'value_object' GROUP BY e.entity"
D03 = "SELECT entity, array_to_string(list(field ORDER BY pos)[1:5], ',') AS fields FROM fx_fields WHERE NOT is_nav AND setter IN ('private', 'none') AND entity IN (SELECT entity FROM fx_entities) GROUP BY entity"
D07 = "SELECT coalesce(a.domain, '?') AS source_domain, coalesce(b.domain, '?') AS target_domain, arg_max(CASE WHEN regexp_matches(via, '(?i)id$') THEN 'id_reference' ELSE 'shared_entity' END, pos) AS coupling FROM fx_rels r JOIN fx_entities a ON a.entity = r.source JOIN fx_entities b ON b.entity = r.target WHERE cross_domain GROUP BY 1, 2"
D06 = "SELECT entity FROM fx_entities WHERE entity LIKE '%Ordered%' OR entity LIKE '%Snapshot%'"
add("D01_aggregate_roots", lambda s, d: M.aggregate_roots(ents(s, d), fields(s, d), hands(s, d)), f"{cte('fx_entities', 'fx_fields', 'fx_handlers')} {D01}")
add("D02_value_objects", lambda s, d: M.value_objects(ents(s, d), fields(s, d)), f"{cte('fx_entities', 'fx_fields')} {D02}")
add("D03_invariants", lambda s, d: M.invariants(ents(s, d), fields(s, d)), f"{cte('fx_entities', 'fx_fields')} {D03}")
add("D04_boundaries", lambda s, d: M.boundaries(ents(s, d), rels(s, d)), f"""{cte('fx_entities', 'fx_rels')}, g AS (SELECT coalesce(aggregate, 'Unknown') AS aggregate, count(*) AS members, count(*) FILTER (kind = 'aggregate_root') AS roots FROM fx_entities GROUP BY 1), h AS (SELECT g.*, (SELECT count(*) FROM fx_rels r JOIN fx_entities e ON e.entity = r.source WHERE cross_domain AND coalesce(e.aggregate, 'Unknown') = g.aggregate) AS refs FROM g)
  SELECT *, CASE WHEN roots = 1 AND refs = 0 THEN 'well_bounded' WHEN roots > 1 THEN 'multiple_roots' WHEN refs > 0 THEN 'cross_domain_leakage' ELSE 'no_root' END AS boundary FROM h""")
add("D05_D08_services_events", lambda s, d: M.services_and_events(hands(s, d)), f"{cte('fx_handlers')} SELECT handler, 'domain_service' AS kind FROM fx_handlers WHERE repos = '' UNION ALL SELECT handler, 'domain_event' FROM fx_handlers WHERE contains(request, 'Event')")
add("D06_anti_corruption", lambda s, d: M.anti_corruption(ents(s, d)), f"{cte('fx_entities')} {D06}")
add("D07_W03_coupling", lambda s, d: M.coupling(rels(s, d), ents(s, d)), f"{cte('fx_entities', 'fx_rels')} {D07}")
add("D09_health", lambda s, d: M.health(ents(s, d), fields(s, d), hands(s, d), rels(s, d)), f"""{cte('fx_entities', 'fx_fields', 'fx_handlers', 'fx_rels')} SELECT CAST(least(100, greatest(0, 50 + (SELECT sum(5 - CASE WHEN exposed <> '' THEN 3 ELSE 0 END + CASE WHEN guarded THEN 2 ELSE 0 END) FROM ({D01})) + (SELECT sum(3 - 3 * n_issues) FROM ({D02}))
  + (SELECT sum(CASE WHEN coupling = 'id_reference' THEN 1 ELSE -5 END) FROM ({D07})) + 3 * (SELECT count(*) FROM ({D06})) + least(20, 2 * (SELECT count(*) FROM ({D03}))))) AS INTEGER) AS score""")
_W = "method IN ('POST', 'PUT', 'PATCH', 'DELETE')"
add("A15_exposure", lambda s, d: M.exposure(eps(s, d)), f"{cte('fx_endpoints')}, e AS (SELECT method, path, auth, unnest(string_split(entities, ',')) AS entity FROM fx_endpoints) SELECT entity, string_agg(method || ' ' || path, ',' ORDER BY method || ' ' || path) AS endpoints, bool_or({_W}) AS writes, bool_or(NOT {_W}) AS reads, bool_or(NOT auth) AS open FROM e WHERE entity <> '' GROUP BY entity")
_p = lambda t, src, col, kind: f"SELECT * FROM (SELECT {src} AS src, unnest(string_split({col}, ',')) AS dst, '{kind}' AS edge FROM {t}) WHERE dst <> ''"
_CALLS = " UNION ALL ".join([_p("fx_endpoints", "method || ' ' || path", "repos", "endpoint_repo"), _p("fx_endpoints", "method || ' ' || path", "services", "endpoint_handler"), _p("fx_handlers", "handler", "repos", "handler_repo"), _p("fx_handlers", "handler", "entities", "handler_entity"), "SELECT repo, entity, 'repo_entity' FROM fx_repos"])
add("J12_G16_usm_calls", lambda s, d: M.usm_calls(eps(s, d), repos(s, d), hands(s, d)), f"{cte('fx_endpoints', 'fx_handlers', 'fx_repos')} {_CALLS}")
add("A19_endpoint_groups", lambda s, d: M.endpoint_groups(eps(s, d)), f"{cte('fx_endpoints')} SELECT string_split(ns, '.')[-1] AS grp, count(*) AS n FROM fx_endpoints GROUP BY 1")
add("A16_domain_summary", lambda s, d: M.domain_summary(frame(s, d, "fx_nodes"), frame(s, d, "fx_edges")), f"{cte('fx_nodes', 'fx_edges')} SELECT domain, count(*) AS nodes, (SELECT count(*) FROM fx_edges e JOIN fx_nodes a ON a.node = e.src JOIN fx_nodes b ON b.node = e.dst WHERE a.domain = n.domain AND b.domain = n.domain) AS internal_edges FROM fx_nodes n GROUP BY domain")
add("A07_type_counts", lambda s, d: M.type_counts(frame(s, d, "fx_edges"), frame(s, d, "fx_kinds")), f"{cte('fx_edges', 'fx_kinds')} SELECT kind, (SELECT count(*) FROM fx_edges e WHERE e.kind = k.kind) AS n FROM fx_kinds k")
add("A21_adjacency", lambda s, d: M.adjacency(rels(s, d)), f"{cte('fx_rels')} SELECT source, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets, count(*) FILTER (cross_domain) AS n_cross FROM fx_rels GROUP BY source")
add("K06_X15_erd", lambda s, d: M.erd_lines(rels(s, d)), f"{cte('fx_rels')} SELECT source || ' ' || CASE kind WHEN 'one_to_many' THEN '||--o{{' WHEN 'many_to_one' THEN '}}o--||' WHEN 'many_to_many' THEN '}}o--o{{' ELSE '||--||' END || ' ' || target || ' : \"' || left(via, 30) || '\"' AS line FROM fx_rels")
add("A18_coverage", lambda s, d: M.coverage(ents(s, d), fields(s, d)), f"{cte('fx_entities', 'fx_fields')} SELECT e.entity, count(*) FILTER (NOT is_nav) AS n_fields, count(*) FILTER (is_nav) AS n_navs, count(*) FILTER (is_pk) AS n_keys FROM fx_entities e LEFT JOIN fx_fields f ON f.entity = e.entity GROUP BY e.entity")
add("A01_A20_model_summary", lambda s, d: M.model_summary(ents(s, d), rels(s, d), eps(s, d), hands(s, d)), f"{cte('fx_entities', 'fx_rels', 'fx_endpoints', 'fx_handlers')} SELECT count(*) AS entities, array_to_string(list_sort(list(DISTINCT aggregate) FILTER (aggregate IS NOT NULL)), ',') AS aggregates, (SELECT count(*) FROM fx_rels) AS relationships, (SELECT count(*) FROM fx_endpoints) AS endpoints, (SELECT count(*) FROM fx_handlers) AS handlers FROM fx_entities")

LISTED = "f AS (SELECT * FROM fx_files WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.vs', 'bin', 'obj', 'node_modules']))"
W = f"{cte('fx_files')}, {LISTED}"
_PACK = "p AS (SELECT path, unnest(regexp_extract_all(text, '<PackageReference Include=\"([^\"]+)\"', 1)) AS package FROM f WHERE path LIKE '%.csproj' OR path LIKE '%.props')"
_CONF = "c AS (SELECT string_agg(text, chr(10) ORDER BY path) AS config FROM f WHERE regexp_matches(path, 'appsettings[^/]*\\.json$'))"
add("S01_listing", lambda s, d: T.listed(files(s, d)).select("path", "size"), f"{W} SELECT path, size FROM f")
add("S05_packages", lambda s, d: T.packages(files(s, d)), f"{W}, {_PACK} SELECT * FROM p")
add("S06_config", lambda s, d: T.config_text(files(s, d)), f"{W}, {_CONF} SELECT * FROM c")
add("S07_X25_source_sample", lambda s, d: T.source_sample(files(s, d)), f"{W} SELECT path, left(text, 2000) AS sample FROM f WHERE path LIKE '%.cs' ORDER BY path LIMIT 30")
add("S08_W08_budget", lambda s, d: T.budgeted(files(s, d), 6000), f"{W}, g AS (SELECT path, sum(size) OVER (ORDER BY CASE WHEN path LIKE '%.sql' THEN 0 WHEN path LIKE '%.cs' THEN 1 ELSE 2 END, path) AS running FROM f) SELECT path, CAST(running AS BIGINT) AS running FROM g WHERE running <= 6000")
add("documents_sources", lambda s, d: M.ranked_top(s.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.sum("n_chars").alias("chars")), "chars", "source", 10), "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS INTEGER) AS place FROM documents GROUP BY source ORDER BY chars DESC, source LIMIT 10")

#: A solution, and what each rule says of it.
_package = lambda *names: "<Project>" + "".join(f'<PackageReference Include="{n}" />' for n in names) + "</Project>"
STACK = [
    ("src/Shop.Web/Shop.Web.csproj", _package("Microsoft.AspNetCore.Components.WebAssembly", "Microsoft.AspNetCore.Mvc.Testing", "MediatR", "Microsoft.EntityFrameworkCore.SqlServer", "StackExchange.Redis")),
    ("src/Shop.Infrastructure/Shop.Infrastructure.csproj", _package("Npgsql.EntityFrameworkCore.PostgreSQL", "Azure.Identity", "Pomelo.EntityFrameworkCore.MySql")),
    ("src/Shop.Domain/Shop.Domain.csproj", _package()), ("tests/Shop.UnitTests/Shop.UnitTests.csproj", _package("xunit", "NSubstitute")), ("src/Tools/Tools.csproj", _package()),
    ("src/Shop.Domain/Entities/Order.cs", "namespace Shop.Domain; class Order : IAggregateRoot { } class M : ValueObject { }"), ("src/Shop.Infrastructure/Data/Db.cs", "class Db : DbContext { DbSet<Order> O; }"), ("src/Shop.Web/Pages/Index.cshtml", "@model Index"),
    ("src/Shop.Web/Program.cs", 'app.MapGet("/", h); // AutoMapper'), ("src/Tools/T.cs", "static class T { }"), ("tests/Shop.UnitTests/OrderTests.cs", "[Fact] void T() {}"), ("svc/main.py", "from fastapi import FastAPI\nfrom sqlalchemy import x"), ("svc/app.js", "const e = require('express')"),
    ("db/a.sql", "create table x (id int identity)"), ("db/b.sql", "id bigserial"), ("db/c.sql", "id int AUTO_INCREMENT"), ("db/d.sql", "create table y (id integer)"), ("appsettings.json", '{"C": "Host=db;port=5432", "R": "redis://x"}'), ("README.md", "x"), ("Dockerfile", "FROM x"), ("node_modules/x.js", "RabbitMQ"),
]
stack = lambda s, d: for_suppliers(s, d, [(f"s~k~/{p}", t) for p, t in STACK], "path string, text string")
add("T01_O05_languages", lambda s, d: T.languages(stack(s, d)), "SELECT language, n * (SELECT count(*) FROM supplier) AS n, is_primary, place FROM (" + values("language, n, is_primary, place", [("C#", 5, True, 1), ("SQL", 4, True, 2), ("Dockerfile", 1, False, 3), ("JSON", 1, False, 4), ("JavaScript", 1, True, 5), ("Markdown", 1, False, 6), ("Python", 1, True, 7), ("Razor (MVC/Pages)", 1, True, 8)]) + ")")
add("T02_frameworks", lambda s, d: T.frameworks(stack(s, d)), "SELECT * FROM (" + values("framework, via", [("Blazor WebAssembly", "Microsoft.AspNetCore.Components.WebAssembly"), ("Blazor Server", "Microsoft.AspNetCore.Components.WebAssembly"), ("ASP.NET Core MVC", "Microsoft.AspNetCore.Mvc.Testing"), ("ASP.NET Core Integration Testing", "Microsoft.AspNetCore.Mvc.Testing"), ("MediatR (CQRS)", "MediatR"), ("Entity Framework Core", "Microsoft.EntityFrameworkCore.SqlServer"), ("xUnit", "xunit"), ("NSubstitute", "NSubstitute"), ("Azure Identity", "Azure.Identity"), ("AutoMapper", "source-code")]) + ") WHERE EXISTS (SELECT 1 FROM supplier)")
add("T03_databases", lambda s, d: T.databases(stack(s, d)), "SELECT * FROM (" + values("db, via, source", [("SQL Server (EF Core)", "Microsoft.EntityFrameworkCore.SqlServer", "package"), ("PostgreSQL", "Npgsql.EntityFrameworkCore.PostgreSQL", "package"), ("MySQL", "Pomelo.EntityFrameworkCore.MySql", "package"), ("Redis", "StackExchange.Redis", "package")]) + ") WHERE EXISTS (SELECT 1 FROM supplier)")
add("T04_architectures", lambda s, d: T.architectures(stack(s, d)), "SELECT * FROM (" + values("architecture, matched, total, confidence", [("DDD (Domain-Driven Design)", 2, 2, "high"), ("CQRS", 1, 1, "high"), ("Minimal API", 1, 1, "high")]) + ") WHERE EXISTS (SELECT 1 FROM supplier)")
add("T05_O06_file_map", lambda s, d: T.file_map(stack(s, d)), per_supplier("path, bucket", [(f"s~k~/{p}", b) for p, b in [("tests/Shop.UnitTests/Shop.UnitTests.csproj", "quality"), ("src/Shop.Domain/Entities/Order.cs", "data"), ("src/Shop.Infrastructure/Data/Db.cs", "architect"), ("src/Shop.Web/Pages/Index.cshtml", "architect"), ("src/Shop.Web/Program.cs", "integration"), ("src/Tools/T.cs", "architect"), ("tests/Shop.UnitTests/OrderTests.cs", "quality"), ("db/a.sql", "data"), ("db/b.sql", "data"), ("db/c.sql", "data"), ("db/d.sql", "data"), ("appsettings.json", "integration"), ("README.md", "architect"), ("Dockerfile", "integration")]]))
add("T08_W09_layers", lambda s, d: T.layers(stack(s, d)), per_supplier("project, layer, confidence", [("Shop.Web", "web", 0.5), ("Shop.Infrastructure", "infrastructure", 0.6), ("Shop.Domain", "domain", 0.6), ("Shop.UnitTests", "test", 0.95), ("Tools", "other", 0.0)]))
add("T09_S10_dialects", lambda s, d: T.dialects(stack(s, d)), "SELECT * FROM (" + per_supplier("path, dialect", [(f"s~k~/{p}", b) for p, b in [("db/a.sql", "sqlserver"), ("db/b.sql", "postgresql"), ("db/c.sql", "mysql"), ("db/d.sql", "sqlite")]]) + ") ORDER BY path LIMIT 10")
add("T06_T07_tech_context", lambda s, d: T.tech_context(stack(s, d)), "SELECT * FROM (" + values("kind, name, place", [("language", "csharp", 0), ("language", "javascript", 1), ("language", "python", 2), ("orm", "ef_core", 0), ("orm", "sqlalchemy", 4), ("api_style", "aspnet_core", 0), ("api_style", "fastapi", 3), ("api_style", "express", 5), ("architecture", "layered_monolith", 0), ("confidence", "0.9", 0)]) + ") WHERE EXISTS (SELECT 1 FROM supplier)")


_NAMES = ("App~.csproj", "pom.xml", "build.gradle", "requirements.txt", "package.json", "appsettings.D~.json", "application-~.yml", "a~.cs", "b~.java", "c~.py", "d~.ts", "e~.js", "f~.kt", "g~.sql", "readme~.md", "pyproject.toml", "docker-compose.x.yml", "h~.cs", "node_modules/i~.js")


def text_files(s, d):
    """Files with the texts of documents, named by their ids."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.replace(name, F.lit("~"), F.col("doc_id").cast("string")))
    return s.read.parquet(f"{d}/documents.parquet").select(path.alias("path"), "text")


_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))
_TEXTS = f"WITH f AS (SELECT source || '/' || doc_id || '/' || replace(CASE doc_id % {len(_NAMES)} {_CASE} END, '~', CAST(doc_id AS VARCHAR)) AS path, text FROM documents)"
_GLOBS = lambda globs: ", ".join(f"({i}, '{g}')" for i, g in enumerate(globs))
_FIRST = "SELECT gno, path, text, row_number() OVER (PARTITION BY gno ORDER BY path) AS n FROM f JOIN (VALUES {globs}) AS g(gno, p) ON string_split(path, '/')[-1] GLOB p"
add("S09_scanned_text", lambda s, d: T.scanned_text(text_files(s, d), T.SOURCE_GLOBS, 30).select("glob", "path", F.sha2("text", 256).alias("digest")), f"{_TEXTS}, x AS ({_FIRST.format(globs=_GLOBS(T.SOURCE_GLOBS))}) SELECT gno AS \"glob\", path, sha256(text) AS digest FROM x WHERE n <= 30")
add("S08_W08_signal_sample", lambda s, d: T.signal_sample(text_files(s, d)).select("place", "path", F.length("chunk").alias("n"), "chars_before"), f"""{_TEXTS}, p AS ({_FIRST.format(globs=_GLOBS(T.PRIORITY_GLOBS))}), c AS ({_FIRST.format(globs=_GLOBS(T.SOURCE_GLOBS))}),
  u AS (SELECT gno, path, length(left(text, 20000)) AS n, 0 AS src FROM p WHERE NOT contains(path, 'node_modules/') UNION ALL SELECT gno + 12, path, length(left(text, 10000)), 1 FROM c WHERE n <= 15 AND NOT contains(path, 'node_modules/')),
  w AS (SELECT path, n, src, sum(n) OVER o - n AS chars_before, sum(src) OVER o - src AS seen, row_number() OVER o - 1 AS place FROM u WINDOW o AS (ORDER BY gno, path ROWS UNBOUNDED PRECEDING))
  SELECT place, path, CAST(n AS INTEGER) AS n, CAST(chars_before AS BIGINT) AS chars_before FROM w WHERE chars_before <= 500000 AND seen < 30""")
_RULES = [(f"orm:{n}", p) for n, p, _ in T.ORMS] + [(f"style:{n}", p) for n, p in T.STYLES] + [(f"dialect:{n}", f"(?i){p}") for n, p in T.DIALECTS] + [(f"architecture:{n}:{i}", f"(?i){p}") for n, ps, _, _ in T.ARCHITECTURES for i, p in enumerate(ps)] + [(f"database:{n}", f"(?i){p}") for p, n in T.DB_CONFIG]
add("T02_T09_rule_hits", lambda s, d: rule_hits(files(s, d), _RULES), f"{cte('fx_files')}, rules AS ({values('rule, pattern', _RULES)}) SELECT path, rule FROM fx_files, rules WHERE regexp_matches(text, pattern)")
