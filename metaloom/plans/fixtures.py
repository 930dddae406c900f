"""A catalog for each supplier, that both engines make from the supplier table.

The rows here are a template. A supplier's catalog takes those whose place and key do not fall on a remainder, so that
catalogs differ in what they lack, and has the key in the names of all its tables, entities, procedures and nodes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (schema, rows)
CATALOGS: dict[str, tuple[str, list[tuple]]] = {}


def _columns() -> list[tuple]:
    """(tbl, ordinal, name, raw_type, norm_type, is_pk, is_nullable, is_fk, is_unique)"""
    tables = {
        "Customer": [("CustomerID", "int", "integer", 1, 0, 0, 1), ("email", "nvarchar(100)", "string", 0, 1, 0, 0), ("phone", "varchar(20)", "string", 0, 1, 0, 0), ("password", "varchar(64)", "string", 0, 0, 0, 0), ("created_at", "datetime", "datetime", 0, 0, 0, 0), ("status", "varchar(10)", "string", 0, 1, 0, 0), ("customer_no", "varchar(12)", "string", 0, 0, 0, 0)],
        "Payment": [("PaymentID", "int", "integer", 1, 1, 0, 0), ("CustomerID", "int", "integer", 0, 1, 1, 0), ("card_number", "char(16)", "string", 0, 0, 0, 0), ("cvv", "int", "integer", 0, 1, 0, 0), ("amount", "money", "decimal", 0, 0, 0, 0), ("is_deleted", "bit", "boolean", 0, 0, 0, 0)],
        "AuditTrail": [("entry", "int", "integer", 0, 0, 0, 0), ("ip_address", "varchar(40)", "string", 0, 1, 0, 0), ("deleted_at", "datetime", "datetime", 0, 1, 0, 0), ("is_active", "bit", "boolean", 0, 0, 0, 0), ("retention_date", "date", "date", 0, 1, 0, 0)],
        "Order": [("OrderID", "bigint", "integer", 1, 0, 0, 1), ("CustomerID", "int", "integer", 0, 0, 1, 0), ("order_date", "datetime2", "datetime", 0, 1, 0, 0), ("ShipName", "nvarchar(40)", "string", 0, 1, 0, 0), ("order_state", "int", "integer", 0, 1, 0, 0), ("remark", "text", "string", 0, 1, 0, 0), ("modified_by", "varchar(30)", "string", 0, 1, 0, 0)],
        "OrderLine": [("OrderID", "bigint", "integer", 1, 0, 1, 0), ("ProductID", "int", "integer", 1, 0, 1, 0), ("qty", "smallint", "integer", 0, 0, 0, 0), ("remark", "text", "string", 0, 1, 0, 0), ("UnitPrice", "money", "decimal", 0, 0, 0, 0), ("SupplierID", "int", "integer", 0, 1, 0, 0)],
        "Product": [("ProductID", "int", "integer", 1, 0, 0, 1), ("sku", "varchar(20)", "string", 0, 0, 0, 0), ("barcode", "varchar(20)", "string", 0, 1, 0, 1), ("SupplierID", "int", "integer", 0, 1, 1, 0), ("remark", "text", "string", 0, 1, 0, 0), ("list_price", "decimal(10,2)", "decimal", 0, 1, 0, 0), ("UnitsInStock", "smallint unsigned", "integer", 0, 1, 0, 0)],
        "Supplier": [("SupplierID", "int", "integer", 1, 0, 0, 1), ("name", "nvarchar(40)", "string", 0, 1, 0, 0), ("fax", "varchar(20)", "string", 0, 1, 0, 0), ("remark", "text", "string", 0, 1, 0, 0), ("secret", "varbinary(32)", "bytes", 0, 1, 0, 0)],
        "Setting": [("code", "varchar(8)", "string", 0, 1, 0, 0), ("value", "sql_variant", "any", 0, 1, 0, 0), ("api_key", "uniqueidentifier", "uuid", 0, 1, 0, 0)],
        "Wide": [(f"metric_{k:02d}", "float", "decimal", 0, 1, 0, 0) for k in range(31)] + [("WideID", "int", "integer", 1, 0, 0, 1)],
    }
    return [(t, k, n, raw, norm, bool(pk), bool(null), bool(fk), bool(uq)) for t, cols in tables.items() for k, (n, raw, norm, pk, null, fk, uq) in enumerate(cols)]


CATALOGS["fx_columns"] = ("tbl string, ordinal int, name string, raw_type string, norm_type string, is_pk boolean, is_nullable boolean, is_fk boolean, is_unique boolean", _columns())
CATALOGS["fx_fks"] = (
    "tbl string, fk string, pos int, col string, ref_tbl string, ref_col string",
    [("Payment", "fk_pay_cust", 0, "CustomerID", "Customer", "CustomerID"), ("Order", "fk_ord_cust", 0, "CustomerID", "customer", "CustomerID"), ("OrderLine", "fk_line_order", 0, "OrderID", "Order", "OrderID"), ("OrderLine", "fk_line_prod", 0, "ProductID", "Product", "ProductID"), ("Product", "fk_prod_supp", 0, "SupplierID", "Supplier", "SupplierID"), ("Order", "fk_ord_ship", 0, "ShipperID", "Shipper", "ShipperID"), ("Customer", "fk_cust_self", 0, "ParentID", "Customer", "CustomerID"), ("Setting", "fk_set_wide", 0, "WideID", "Wide", "WideID")],
)
CATALOGS["fx_checks"] = ("tbl string, n int, expr string", [("Order", 0, "order_state > 0"), ("Product", 0, "list_price >= 0")])
CATALOGS["fx_indexes"] = ("tbl string, idx string, pos int, col string, is_unique boolean", [("Payment", "ix_pay_cust", 0, "CustomerID", False), ("Product", "ux_sku", 0, "sku", True), ("Order", "ix_ord", 0, "order_date", False)])
CATALOGS["fx_views"] = ("view string, source string, pos int", [("vOrders", "Order", 0), ("vOrders", "Customer", 1), ("vSales", "vOrders", 0), ("vSales", "OrderLine", 1), ("vSales", "Product", 2), ("vGhost", "Missing", 0), ("vStock", "Product", 0), ("vStock", "Supplier", 1)])
CATALOGS["fx_procs"] = (
    "proc string, body string",
    [
        ("GetOrders", "AS SELECT o.OrderID, c.email AS mail FROM Order o INNER JOIN Customer c ON o.CustomerID = c.CustomerID WHERE o.order_state = 1"),
        ("CopyOrders", "AS BEGIN TRAN INSERT INTO Archive SELECT * FROM Order WHERE order_state = 9 DELETE FROM Order WHERE order_state = 9 COMMIT EXEC LogIt RETURN 0"),
        ("ZeroStock", "AS UPDATE Product SET UnitsInStock = 0"),
        ("PurgeLog", "AS BEGIN TRY BEGIN TRANSACTION DELETE FROM AuditTrail COMMIT END TRY BEGIN CATCH ROLLBACK RAISERROR('x',16,1) END CATCH"),
        ("RunSafe", "AS EXEC sp_executesql @sql EXEC LogIt"),
        ("RunRisky", "AS EXEC('SELECT * FROM ' + @tbl) EXEC CopyOrders"),
        ("LogIt", "AS INSERT INTO AuditTrail SELECT 1 IF @@ROWCOUNT = 0 RETURN -1 EXEC RunSafe"),
        ("Walk", "AS DECLARE cur CURSOR FOR SELECT SupplierID FROM Supplier IF EXISTS (SELECT 1 FROM #tmp) UPDATE Supplier SET name = 'x' WHERE SupplierID = 1"),
        ("Alone", "AS RETURN 1"),
        ("LoopA", "AS EXEC LoopB"),
        ("LoopB", "AS EXEC LoopA"),
    ],
)
CATALOGS["fx_edges"] = (
    "src string, dst string, kind string, pos int",
    [("a", "b", "fk", 0), ("b", "c", "fk", 1), ("c", "a", "fk", 2), ("a", "d", "read", 3), ("a", "d", "write", 4), ("d", "e", "read", 5), ("e", "f", "read", 6), ("f", "g", "write", 7), ("g", "h", "read", 8), ("h", "i", "read", 9), ("s", "s", "fk", 10), ("d", "s", "read", 11), ("x", "y", "fk", 12)],
)
CATALOGS["fx_nodes"] = ("node string, domain string", [(n, d) for n, d in zip("abcdefghisxyz", ["one", "one", "one", "two", "two", "three", "three", "three", "one", "two", "four", "four", "five"])])
CATALOGS["fx_entities"] = (
    "entity string, kind string, aggregate string, domain string, bases string, file string",
    [("Order", "aggregate_root", "Order", "Sales", "Entity,IRoot", "src/Sales/Order.cs"), ("OrderLine", "entity", "Order", "Sales", "Entity", "src/Sales/OrderLine.cs"), ("OrderCopy", "entity", "Archive", "Archive", "Entity", "src/Archive/OrderCopy.cs"), ("Customer", "aggregate_root", "Customer", "Crm", "Entity,IRoot", "src/Crm/Customer.cs"), ("Client", "entity", "Crm", "Crm", "IRoot,Entity", "src/Crm/Client.cs"), ("Address", "value_object", "Customer", "Crm", "ValueObject", "src/Crm/Address.cs"), ("Money", "value_object", None, None, "ValueObject", "src/Shared/Money.cs"), ("Ghost", "aggregate_root", "Ghost", "Misc", "Entity", "src/Misc/Ghost.cs"), ("Wraith", "entity", None, None, "Entity", "src/Misc/Wraith.cs"), ("ProductOrdered", "entity", "Order", "Sales", "", "src/Sales/ProductOrdered.cs")],
)
CATALOGS["fx_fields"] = (
    "entity string, pos int, field string, type string, is_pk boolean, is_nullable boolean, pii string, is_nav boolean, getter string, setter string",
    [
        ("Order", 0, "Id", "int", True, False, None, False, "public", "private"), ("Order", 1, "Total", "decimal", False, False, None, False, "public", "private"), ("Order", 2, "Placed", "DateTime", False, True, None, False, "public", "public"), ("Order", 3, "CustomerId", "int", False, False, None, False, "public", "private"), ("Order", 4, "Lines", "List<OrderLine>", False, True, None, True, "public", "public"), ("Order", 5, "Note", "string", False, True, None, False, "public", "none"), ("Order", 6, "State", "int", False, False, None, False, "public", "private"), ("Order", 7, "Buyer", "string", False, True, "medium", False, "public", "private"),
        ("OrderLine", 0, "Id", "int", True, True, None, False, "public", "private"), ("OrderLine", 1, "OrderId", "int", False, False, None, False, "public", "private"), ("OrderLine", 2, "ProductId", "int", False, False, None, False, "public", "private"), ("OrderLine", 3, "Qty", "int", False, False, None, False, "public", "public"),
        ("OrderCopy", 0, "Id", "long", True, False, None, False, "public", "public"), ("OrderCopy", 1, "Total", "decimal", False, False, None, False, "public", "public"), ("OrderCopy", 2, "Placed", "DateTime", False, True, None, False, "public", "public"), ("OrderCopy", 3, "CustomerId", "int", False, False, None, False, "public", "public"), ("OrderCopy", 4, "Note", "string", False, True, None, False, "public", "public"), ("OrderCopy", 5, "State", "int", False, False, None, False, "public", "public"), ("OrderCopy", 6, "CreatedBy", "string", False, True, None, False, "public", "public"),
        ("Customer", 0, "Id", "int", True, False, None, False, "public", "private"), ("Customer", 1, "Email", "string", False, True, "medium", False, "public", "public"), ("Customer", 2, "Password", "string", False, False, "high", False, "public", "private"), ("Customer", 3, "Home", "Address", False, True, None, True, "public", "private"), ("Customer", 4, "created_at", "DateTime", False, True, None, False, "public", "private"),
        ("Client", 0, "Id", "int", True, False, None, False, "public", "private"), ("Client", 1, "Email", "string", False, True, "medium", False, "public", "public"), ("Client", 2, "Password", "string", False, False, "high", False, "public", "private"), ("Client", 3, "created_at", "DateTime", False, True, None, False, "public", "private"),
        ("Address", 0, "Street", "string", False, True, "medium", False, "public", "private"), ("Address", 1, "City", "string", False, True, None, False, "public", "public"),
        ("Money", 0, "Id", "int", False, True, None, False, "public", "private"), ("Money", 1, "Amount", "decimal", False, False, None, False, "public", "private"),
        ("Ghost", 0, "Name", "string", False, True, "low", False, "public", "private"), ("Ghost", 1, "CustomerId", "int", False, False, None, False, "public", "private"),
        ("Wraith", 0, "Name", "string", False, True, "low", False, "public", "private"), ("Wraith", 1, "CustomerId", "int", False, False, None, False, "public", "private"),
        ("ProductOrdered", 0, "ProductId", "int", False, False, None, False, "public", "private"), ("ProductOrdered", 1, "CardNumber", "string", False, True, "high", False, "public", "private"),
    ],
)
CATALOGS["fx_rels"] = (
    "source string, target string, kind string, via string, cross_domain boolean, confidence string, pos int",
    [("Order", "OrderLine", "one_to_many", "Lines", False, "HIGH", 0), ("OrderLine", "Order", "many_to_one", "OrderId", False, "HIGH", 1), ("Order", "Customer", "many_to_one", "CustomerId", True, "MEDIUM", 2), ("Order", "Customer", "many_to_one", "CustomerId", True, "LOW", 3), ("Customer", "Address", "owns_one", "Home", False, "HIGH", 4), ("OrderCopy", "Order", "references", "SourceId", True, "LOW", 5), ("Customer", "Order", "one_to_many", "Orders", True, "MEDIUM", 6), ("Ghost", "Nowhere", "many_to_one", "NowhereId", False, "LOW", 7), ("Client", "Order", "many_to_many", "Orders", True, "HIGH", 8), ("OrderLine", "Product", "many_to_one", "ProductId", True, "HIGH", 9)],
)
CATALOGS["fx_endpoints"] = (
    "method string, path string, auth boolean, anon boolean, repos string, services string, entities string, ns string",
    [("GET", "/orders", False, False, "OrderRepo", "", "Order", "Api.Orders"), ("POST", "/orders", True, False, "OrderRepo", "PlaceOrder", "Order,OrderLine", "Api.Orders"), ("DELETE", "/orders/{id}", False, False, "OrderRepo", "", "Order", "Api.Orders"), ("PUT", "/payment/{id}", False, False, "", "Pay", "", "Api.Billing"), ("GET", "/admin/users", False, False, "CustomerRepo", "", "Customer", "Api.Admin"), ("GET", "/health", False, True, "", "", "", "Api"), ("GET", "/token", True, False, "", "", "", "Api.Auth")],
)
CATALOGS["fx_repos"] = ("repo string, entity string", [("OrderRepo", "Order"), ("CustomerRepo", "Customer"), ("LineRepo", "OrderLine")])
CATALOGS["fx_handlers"] = ("handler string, request string, repos string, entities string, guards int", [("PlaceOrder", "PlaceOrderCommand", "OrderRepo,LineRepo", "Order,OrderLine", 2), ("Pay", "PayCommand", "", "Customer", 0), ("OnPaid", "OrderPaidEvent", "OrderRepo", "Order", 1), ("Audit", "AuditQuery", "", "", 0)])
CATALOGS["fx_evidence"] = ("subject string, kind string, weight double", [("r1", "fk", 0.95), ("r1", "ast", 0.85), ("r2", "naming", 0.55), ("r2", "view", 0.6), ("r3", "name", 0.3), ("r4", "ast", 0.98), ("r4", "fk", 0.99), ("r4", "dbcontext", 0.9)])
CATALOGS["fx_subjects"] = ("subject string", [("r1",), ("r2",), ("r3",), ("r4",), ("r5",)])
CATALOGS["fx_steps"] = ("flow string, pos int, layer string, component string, confidence string", [("f1", 0, "api", "GET /orders", "HIGH"), ("f1", 1, "service", "Place", "MEDIUM"), ("f1", 2, "repository", "OrderRepo", "HIGH"), ("f1", 3, "entity", "Order", "HIGH"), ("f2", 0, "api", "GET /x", "HIGH"), ("f2", 1, "dto", "XDto", "LOW"), ("f3", 0, "api", "POST /y", "MEDIUM"), ("f3", 1, "entity", "Customer", "HIGH"), ("f3", 2, "dto", "YDto", "HIGH")])
CATALOGS["fx_calls"] = (
    "method string, path string, cls string, auth boolean, request string, response string, services string, repos string, file string",
    [
        ("GET", "/Order/{id}", "GetOrder", False, None, "OrderDto", "", "IReadRepository<Order>", "api/GetOrder.cs"),
        ("POST", "/Order", "PostOrder", True, "OrderRequest", "OrderDto", "Placing,Pricing", "IRepository<Order>,IRepository<Customer>", "api/PostOrder.cs"),
        ("PUT", "/Customer", "PutCustomer", True, "CustomerRequest", None, "", "IRepository<Customer>,IRepository<Customer>", "api/PutCustomer.cs"),
        ("GET", "/Product", "GetProduct", False, "StockQuery", "StockDto", "Counting", "IRepository<Stock>", "api/GetProduct.cs"),
        ("GET", "/Setting/health", "SettingHealth", False, None, None, "", "", "api/SettingHealth.cs"),
        (None, "/Wide", "Odd", None, "", "", "", "Unit,IRepository<OrderLine>", "api/Odd.cs"),
    ],
)
CATALOGS["fx_asks"] = ("cls string, request string, response string, repos string, file string", [("AskOrder", "OrderAsk", "OrderView", "IReadRepository<Order>,IReadRepository<Client>", "app/AskOrder.cs"), ("AskGhost", "GhostAsk", "void", "IRepository<Nothing>", "app/AskGhost.cs"), ("AskMoney", None, "int", "IRepository<Money>", "app/AskMoney.cs")])
CATALOGS["fx_screens"] = ("cls string, method string, entities string, file string", [("CartPage", "GET", "Order,Address", "web/CartPage.cs"), ("CartPage", "POST", "Order,Shipper", "web/CartPage.cs"), ("AloneAbout", "GET", "", "web/AboutPage.cs")])
CATALOGS["fx_dtos"] = ("dto string, file string", [("OrderDto", "api/GetOrder.cs"), ("OrderRequest", "api/PostOrder.cs"), ("StockDto", "api/GetProduct.cs")])
CATALOGS["fx_files"] = (
    "path string, size int, text string",
    [("src/Api/Program.cs", 900, "using Microsoft.EntityFrameworkCore; builder.Services.AddMediatR(cfg); app.MapGet(\"/orders\", h); CommandHandler QueryHandler"), ("src/Domain/Order.cs", 700, "class Order : Entity { } AggregateRoot ValueObject DomainEvent"), ("src/Infrastructure/Db.cs", 400, "class Db : DbContext { DbSet<Order> Orders; UseSqlServer(x); Repository }"), ("web/app.ts", 1200, "import express from 'express'; router.get('/a', h)"), ("web/view.tsx", 300, "import React from 'react'"), ("svc/main.py", 500, "from fastapi import FastAPI"), ("db/schema.sql", 2500, "CREATE TABLE [dbo].[Order] (id int IDENTITY(1,1)) GO"), ("db/more.sql", 1500, "CREATE TABLE x (id serial primary key)"), ("node_modules/lib/index.js", 9000, "module.exports = {}"), ("bin/Debug/app.dll.cs", 10, "x"), ("appsettings.json", 120, "{\"ConnectionStrings\":{\"Default\":\"Server=sql;Database=shop\"},\"Redis\":\"localhost\"}"), ("appsettings.Dev.json", 60, "{\"Redis\":\"dev\"}"), ("test/OrderTests.cs", 200, "[Fact] public void T() {}"), ("App.csproj", 300, "<Project><ItemGroup><PackageReference Include=\"MediatR\" /><PackageReference Include=\"Microsoft.EntityFrameworkCore.SqlServer\" /></ItemGroup></Project>")],
)
CATALOGS["fx_types"] = ("raw string", [("INT",), ("NVARCHAR(100)",), ("decimal(10, 2)",), ("smallint unsigned",), ("Money",), ("uniqueidentifier",), ("",), ("hstore",), ("datetimeoffset(7)",), ("BIT",), ("geometry",), ("int zerofill",)])
CATALOGS["fx_code_types"] = ("raw string", [("string",), ("int?",), ("List<Order>",), ("byte[]",), ("DateTime?",), ("BigDecimal",), ("object",), ("Date",), ("Guid",), ("Custom",), ("",), ("Record<string>",)])


#: Names that get a supplier's key, longer ones first.
_NAMES = "ProductOrdered OrderLine OrderCopy AuditTrail Customer Supplier Product Payment Setting Shipper Address Archive Missing Nowhere Client Wraith Ghost Money Order Wide vSales vStock LogIt RunSafe RunRisky PurgeLog ZeroStock LoopA LoopB Walk Alone".split()
_NAMED = re.compile("|".join(_NAMES))
#: Columns of names that are plain letters.
_PLAIN = {"fx_edges": ("src", "dst"), "fx_keys": ("src", "dst"), "fx_nodes": ("node",), "fx_evidence": ("subject",), "fx_subjects": ("subject",), "fx_steps": ("flow",)}
MARK, STEP, AT = "~k~", 9, 4


def _template(name: str) -> tuple[list[list[str]], list[tuple]]:
    """([name, type] of each column, rows with MARK where a key goes)."""
    schema, rows = CATALOGS[name]
    cols = [c.split() for c in schema.split(", ")]

    def marked(col: str, x):
        if not isinstance(x, str):
            return x
        if col in _PLAIN.get(name, ()) or x.lower() in {n.lower() for n in _NAMES} and not _NAMED.search(x):
            return x + MARK
        if name == "fx_files" and col == "path":
            return f"s{MARK}/{x}"
        return _NAMED.sub(lambda m: m[0] + MARK, x)

    return cols, [tuple(marked(c, x) for (c, _), x in zip(cols, r)) for r in rows]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    cols, rows = _template(name)
    template = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["_i int", *(f"{c} {t}" for c, t in cols)]))
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("_i"))
    made = keys.where(F.pmod(F.col("_k") * 7 + F.col("_i") * 11, F.lit(STEP)) != AT).join(F.broadcast(template), "_i")
    return made.select(*[F.replace(c, F.lit(MARK), F.col("_k").cast("string")).alias(c) if t == "string" else F.col(c) for c, t in cols])


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + x.replace("'", "''") + "'"


SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def cte(*names: str) -> str:
    """WITH RECURSIVE ... of the named catalogs, to be followed by further CTEs or a SELECT."""
    parts = []
    for name in names:
        cols, rows = _template(name)
        values = ", ".join(f"({i}, " + ", ".join(map(_literal, r)) + ")" for i, r in enumerate(rows))
        cast = ", ".join(f"CAST(replace({c}, '{MARK}', CAST(s_suppkey AS VARCHAR)) AS VARCHAR) AS {c}" if t == "string" else f"CAST({c} AS {SQL_TYPES[t]}) AS {c}" for c, t in cols)
        parts.append(f"{name} AS MATERIALIZED (SELECT {cast} FROM supplier, (VALUES {values}) AS v(_i, {', '.join(c for c, _ in cols)}) WHERE (s_suppkey * 7 + _i * 11) % {STEP} <> {AT})")
    return "WITH RECURSIVE " + ",\n".join(parts)
