"""Queries of aggregates by name, their guards, and orders and subsets of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import aggregates as A
from metaloom.operators import code as C
from metaloom.operators import governance as G
from metaloom.operators import graph, procedures
from metaloom.plans import code
from metaloom.plans import governance as GV
from metaloom.plans.fixtures import cte, frame
from metaloom.plans.registry import ORACLES, add, for_suppliers, per_part, per_supplier
from metaloom.sources.scratch import cut

_C = ("namespace", "entity", "path")
#: (namespace, entity, path, its aggregate)
_PATHS = [
    ("Shop~k~.OrderAggregate.Entities", "Order~k~", "src/Other/Order.cs", "OrderAggregate"), ("Shop.Aggregate", "Item", "src/Core/Basket~k~Aggregate/Item.cs", "Basket~k~Aggregate"), ("Shop.Models", "Buyer", "src/Buyers~k~/Buyer.cs", "Buyers~k~"),
    ("Shop~k~.Entities", "Cart", "src/Entities/Cart.cs", "Shop~k~"), ("Models.Data", "Tag~k~", "Models/Tag.cs", "Tag~k~Aggregate"), ("", "Lone~k~", "", "Lone~k~Aggregate"), (None, None, None, "Aggregate"), ("ab.X~k~Y.cd", "E", "E.cs", "X~k~Y"), ("N.Data", "W", "a\\Win~k~\\W.cs", "Win~k~"),
]
_PACKAGES = [("com.shop.order.entity", "Order~k~", "OrderAggregate"), ("com.CATALOG.Model", "P", "CatalogAggregate"), ("a.b.domain", "Q~k~", "Q~k~Aggregate"), (None, "R~k~", "R~k~Aggregate"), ("x.item~k~.dto", "S", "Item~k~Aggregate")]
_MODULES = [("shop/Orders~k~/models.py", "Order", "Orders~k~Aggregate"), ("apps/core/models.py", "Tag~k~", "Tag~k~Aggregate"), ("models.py", "M~k~", "M~k~Aggregate"), ("proj/billing.py/apps/x.py", "B", "BillingAggregate"), (None, None, "Aggregate")]
_made = lambda rows, schema: lambda s, d: for_suppliers(s, d, [r[:-1] for r in rows], schema)
add("X08_aggregate_of", lambda s, d: _made(_PATHS, "namespace string, entity string, path string")(s, d).select("entity", A.aggregate_of(*map(F.col, _C)).alias("aggregate")), per_supplier("entity, aggregate", [(r[1], r[3]) for r in _PATHS]))
add("X09_aggregate_of_package", lambda s, d: _made(_PACKAGES, "package string, entity string")(s, d).select("entity", A.aggregate_of_package(F.col("package"), F.col("entity")).alias("aggregate")), per_supplier("entity, aggregate", [r[1:] for r in _PACKAGES]))
add("X09_aggregate_of_module", lambda s, d: _made(_MODULES, "path string, entity string")(s, d).select("entity", A.aggregate_of_module(F.col("path"), F.col("entity")).alias("aggregate")), per_supplier("entity, aggregate", [r[1:] for r in _MODULES]))


def _of_code(operator):
    """A query of an operator over classes, properties and constructor parameters of the made files, read once."""

    def query(s, d):
        found = cut(C.types(code.files(s, d)))
        classes = C.classes(found).where("is_root OR is_value").select(F.col("name").alias("entity"), "is_root")
        return operator(classes, C.properties(found), C.constructor_parameters(found))

    return query


add("D01_guarded_roots", _of_code(A.guarded_roots), per_part("entity, exposed, has_encapsulation_issue, has_guard_clauses", [("Order~k~", "Lines", True, True)]))
add("D03_invariants_of_code", _of_code(A.invariants_of), per_part("entity, kind, names", [("Order~k~", "constructor_guard", "n,name"), ("Order~k~", "private_setter_invariant", "Id")]))
add("D06_layers", lambda s, d: A.anti_corruption_layers(frame(s, d, "fx_entities"), A.mapper_profiles(code.files(s, d))), f"{cte('fx_entities')} SELECT entity AS name, 'snapshot_acl' AS kind, '' AS mappings FROM fx_entities WHERE entity LIKE '%Ordered%' UNION ALL {per_part('name, kind, mappings', [('M', 'automapper_profile', 'Order~k~>OrderDto')])}")


def procedure_totals(s, d):
    """One row: the distinct tables that procedures touch and the deepest call."""
    procs = frame(s, d, "fx_procs")
    touched = procedures.tables(procs).select(F.explode(F.split("tables", ",")).alias("tbl")).where("tbl <> ''").distinct()
    depth = graph.call_depths(procs, procedures.calls(procs)).agg(F.max("call_depth").alias("max_call_depth"))
    return touched.agg(F.count(F.lit(1)).alias("n_tables")).join(depth)  # one row each


add("A09_procedure_totals", procedure_totals, f"SELECT (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(tables, ',')) AS t FROM ({ORACLES['P14_P13_X10_proc_tables']})) WHERE t <> '') AS n_tables, (SELECT max(call_depth) FROM ({ORACLES['G13_call_depth']})) AS max_call_depth")
_found = lambda s, d: G.field_patterns(frame(s, d, "fx_fields"))
_HIT = f"{cte('fx_fields')}, hit AS ({GV.F30})"
add("F37_severities", lambda s, d: A.count_by(_found(s, d), "severity"), f"{_HIT} SELECT severity AS value, count(*) AS n FROM hit GROUP BY severity")
add("F37_subsets", lambda s, d: A.subsets(_found(s, d)), f"{_HIT} SELECT *, 'gdpr' AS subset FROM hit WHERE category <> '' UNION ALL SELECT *, 'pci' FROM hit WHERE rule = 'pci_dss'")
_ORDER = "row_number() OVER (ORDER BY CASE {c} WHEN '{x[0]}' THEN 0 WHEN '{x[1]}' THEN 1 WHEN '{x[2]}' THEN 2 ELSE 3 END, rule, entity, field, pattern) - 1 AS place"
_THEN = ["rule", "entity", "field", "pattern"]
add("O04_by_severity", lambda s, d: A.by_severity(_found(s, d), _THEN), f"{_HIT} SELECT *, {_ORDER.format(c='severity', x=A.SEVERITIES)} FROM hit")
add("O04_by_confidence", lambda s, d: A.by_confidence(_found(s, d), _THEN), f"{_HIT} SELECT *, {_ORDER.format(c='confidence', x=A.CONFIDENCES)} FROM hit")
add("O01_by_source", lambda s, d: A.by_source(frame(s, d, "fx_rels").select("source", "target", "pos"), ["pos"]), f"{cte('fx_rels')} SELECT source, target, pos, row_number() OVER (ORDER BY source, pos) - 1 AS place FROM fx_rels")
