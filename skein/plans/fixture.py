"""The driver tables as graphs, chunks, statements and benchmark cases.

``VIEWS`` are plain SELECTs in the dialect that Spark and the checking engine
share; names in braces are tables or views before them.

nodes  regions are controllers (entry points), nations services, suppliers
       repositories, customers services, brands entities with a table
edges  calls along the foreign keys; entity access from each supplier to the
       brands of the parts it delivers, with a confidence by how often
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, table

VIEWS = {
    "nodes": """
SELECT 'region:' || CAST(r_regionkey AS STRING) AS id, 'method' AS kind, 'RegionController.Get' || r_name AS label, 'P' || CAST(r_regionkey AS STRING) AS project_name,
       'app.region' AS namespace, 'RegionController' AS class_name, 'Get' || r_name AS method_name, true AS entry_point, '/region/' || CAST(r_regionkey AS STRING) AS route, CAST(NULL AS STRING) AS table_name, false AS is_external FROM {region}
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'method', 'NationService.Load' || n_name, 'P' || CAST(n_regionkey AS STRING), 'app.nation', 'NationService', 'Load' || n_name, false, CAST(NULL AS STRING), CAST(NULL AS STRING), false FROM {nation}
UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'method', 'SupplierRepository.Find' || s_name, 'P' || CAST(n_regionkey AS STRING), 'app.supplier', 'SupplierRepository', 'Find' || s_name, false, CAST(NULL AS STRING), CAST(NULL AS STRING), false FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 'method', 'CustomerService.Check' || c_name, 'P' || CAST(n_regionkey AS STRING), 'app.customer', 'CustomerService', 'Check' || c_name, false, CAST(NULL AS STRING), CAST(NULL AS STRING), false FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'entity', p_brand, 'data', 'app.data', p_brand, '', false, CAST(NULL AS STRING), p_brand, true FROM {part}""",
    "access": """
SELECT 'supplier:' || CAST(l_suppkey AS STRING) AS from_id, 'brand:' || p_brand AS to_id, count(*) AS weight FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand""",
    "edges": """
SELECT 'region:' || CAST(n_regionkey AS STRING) AS from_id, 'nation:' || CAST(n_nationkey AS STRING) AS to_id, 'call' AS kind, 'exact' AS confidence, 'semantic' AS evidence, CAST(1 AS BIGINT) AS weight FROM {nation}
UNION ALL SELECT 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'call', 'high', 'semantic', CAST(1 AS BIGINT) FROM {supplier}
UNION ALL SELECT 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'call', 'medium', 'syntax', CAST(1 AS BIGINT) FROM {customer}
UNION ALL SELECT from_id, to_id, 'entity-access', CASE WHEN weight >= 40 THEN 'exact' WHEN weight >= 25 THEN 'high' WHEN weight >= 12 THEN 'medium' ELSE 'low' END, 'analyzer', CAST(weight AS BIGINT) FROM {access}""",
    # event types in a user's order: a graph with cycles and self-loops
    "steps": """
SELECT event_type AS from_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id FROM {events}""",
    "cyclic": """
SELECT from_id, to_id, 'call' AS kind, count(*) AS weight FROM {steps} WHERE to_id IS NOT NULL GROUP BY from_id, to_id""",
    # a chunk for each vector; its features follow from its id
    "chunks": """
SELECT vec_id AS chunk_id, 'chunk:' || CAST(vec_id AS STRING) AS title, CAST(label AS INT) AS label, CAST(vec_id % 7 AS INT) - 1 AS entry_distance, CAST(vec_id % 5 AS INT) - 1 AS data_distance, CAST(vec_id * 7 % 30 AS INT) AS max_fan,
       CAST(1 + vec_id % 4 AS INT) AS n_nodes, CAST(vec_id % 3 AS INT) AS n_grounded, vec_id % 6 = 0 AS is_entry, vec_id % 4 = 0 AS has_access, 'T' || CAST(label AS STRING) AS table_name, 'E' || CAST(vec_id % 8 AS STRING) AS entity_name,
       CAST(vec_id * 37 % 100 AS DOUBLE) / 10 AS importance, CAST(vec_id % 10 AS DOUBLE) / 10 AS confidence FROM {embeddings}""",
    # code units: a loader for each nation that calls its suppliers' finders by name
    "units": """
SELECT 'method:P' || CAST(n_regionkey AS STRING) || '::app.NationService.Load' || CAST(n_nationkey AS STRING) || '()' AS id, 'P' || CAST(n_regionkey AS STRING) AS project_name, 'app' AS namespace, 'NationService' AS class_name, 'Load' || CAST(n_nationkey AS STRING) AS method_name,
       'call Load' || CAST((n_nationkey + 5) % 25 AS STRING) || '(); TryFind' || CAST(n_nationkey + 1 AS STRING) || '(x); Find' || CAST(n_nationkey * 3 + 1 AS STRING) || '(y)' AS content FROM {nation}
UNION ALL SELECT 'method:P' || CAST(n_regionkey AS STRING) || '::app.SupplierRepository.Find' || CAST(s_suppkey AS STRING) || '()', 'P' || CAST(n_regionkey AS STRING), 'app', 'SupplierRepository', 'Find' || CAST(s_suppkey AS STRING), 'FROM supplier; Find' || CAST(s_suppkey AS STRING) || '(z)' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # statements: a conversation's turns; subject and confidence follow from the ids
    "statements": """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS statement_id, 'conv:' || CAST(conv_id % 40 AS STRING) AS subject_id, CASE WHEN turn % 6 = 0 THEN 'it is valid ' WHEN turn % 6 = 1 THEN 'it is not valid ' WHEN turn % 6 = 2 THEN 'enables cache ' WHEN turn % 6 = 3 THEN 'disables cache ' WHEN turn % 6 = 4 THEN 'primary workflow ' ELSE '' END || lower(text) AS claim, role AS tone,
       CAST((conv_id * 7 + turn * 13) % 100 AS DOUBLE) / 100 AS score, CAST(turn % 4 AS INT) AS hop, turn % 5 = 0 AS speculative_ancestor, turn % 7 = 6 AS suppressed FROM {conversations} WHERE conv_id IS NOT NULL AND turn IS NOT NULL""",
    # the same statements later: some gone, some changed
    "later": """
SELECT statement_id, subject_id, claim, tone, CASE WHEN hop = 1 THEN least(1.0, score + 0.1) ELSE score * 0.95 END AS score, hop, speculative_ancestor, suppressed FROM {statements} WHERE NOT (hop = 3 AND suppressed)""",
    "calls": """
SELECT id AS unit_id, project_name, class_name, 'app.SupplierRepository.Find' || CAST(n AS STRING) AS target, 'app' AS target_namespace, n % 5 = 0 AS external FROM {units} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 5 UNION ALL SELECT 999) x WHERE class_name = 'NationService'""",
    # questions in two languages, by intent, with names, with the name of a node, and without either
    "questions": """
SELECT item_id, CASE item_id % 13 WHEN 0 THEN ' Explain the architecture of RegionController, please? ' WHEN 1 THEN 'What breaks  if SupplierRepository.Find changes' WHEN 2 THEN '"why does" LoadNATION_7 fail?' WHEN 3 THEN 'where is the customer check implemented'
 WHEN 4 THEN 'loadnation_' || CAST(item_id % 25 AS STRING) WHEN 5 THEN '谁调用了 OrderService.Save' WHEN 6 THEN '为什么 报错' WHEN 7 THEN '如何实现 Login, Logout' WHEN 8 THEN '项目结构' WHEN 9 THEN text WHEN 10 THEN '' WHEN 11 THEN 'Nation' ELSE 'Brand#1' || CAST(item_id % 5 AS STRING) || ' and Brand#1' END AS text FROM {benchmark}""",
    # bodies of the units: literals with queries, addresses and paths, settings, exceptions and transfer types
    "bodies": """
SELECT id, namespace, class_name, method_name, content || CASE length(id) % 2 + 2 * (length(content) % 3) WHEN 0 THEN ' Run("select a from ORDERS o join Item i where x"); throw new OrderException("no OrderLine left");'
 WHEN 1 THEN ' try Call("https://api.example.com/v1/x", "http://b.example/y"); catch (TimeoutException e);' WHEN 2 THEN ' var s = Configuration["Db:Main"] + AppSettings["Mode"]; return new OrderDto(new LoadRequest());' WHEN 3 THEN ' Read("../data/a.csv", "~/b.txt"); ConfigHelper.Get("Path"); new itemDTO();'
 WHEN 4 THEN ' [HttpGet("orders/list")] try Save("update STOCK set n = 1"); catch (IOException e) throw new AppException("x");' ELSE ' Plain("text");' END AS content FROM {units}""",
    "unit_calls": """
SELECT DISTINCT c.unit_id AS from_id, u.id AS to_id FROM {calls} c JOIN {units} u ON c.target = u.namespace || '.' || u.class_name || '.' || u.method_name WHERE NOT c.external""",
    # tables of a code base's declarations: some by hand, the others by nation and supplier
    "actions": """
SELECT * FROM (VALUES ('OrderController', 'ControllerBase', 'GetOrder', '', 'api/[controller]', 'byid', true, false), ('OrderController', 'ControllerBase', 'CreateOrder', '', 'api/[controller]', '', true, false), ('OrderController', 'ControllerBase', 'Helper', 'NonAction', 'api/[controller]', '', true, false),
 ('StockController', 'ControllerBase', 'Remove', 'HttpPost', '', 'stock/[action]/', true, false), ('StockController', 'ControllerBase', 'Patchwork', '', '', '', true, false), ('StockController', 'ControllerBase', 'Hidden', '', '', '', false, false), ('PriceService', 'object', 'GetPrice', '', '', '', true, false), ('HomeController', 'Controller', 'Index', 'HttpGet', 'home', '/', true, true)) AS t(class_name, base_type, method_name, attribute, class_route, method_route, is_public, is_static)
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 5 = 0 THEN 'Service' ELSE 'Controller' END, CASE WHEN s_suppkey % 10 = 0 THEN 'Controller' ELSE 'object' END, CASE s_suppkey % 4 WHEN 0 THEN 'GetAll' WHEN 1 THEN 'CreateOne' WHEN 2 THEN 'RemoveIt' ELSE 'Patch' END,
 CASE s_suppkey % 6 WHEN 0 THEN 'HttpPut' WHEN 1 THEN 'NonAction' ELSE '' END, CASE WHEN s_suppkey % 2 = 0 THEN 'api/[controller]' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN 'x/[action]/' ELSE '' END, s_suppkey % 7 <> 0, s_suppkey % 11 = 0 FROM {supplier}""",
    "beans": """
SELECT * FROM (VALUES ('orderService', 'app.OrderService', 'orderDao', 'beans.xml'), ('orderDao', 'app.OrderDao', '', 'beans.xml'), ('stockService', 'app.StockService', 'orderDao', 'beans.xml'), ('stockService', 'app.StockService', 'missing', 'beans.xml')) AS t(bean_id, type_name, ref, file)
UNION ALL SELECT 'bean' || CAST(s_suppkey AS STRING), 'app.n' || CAST(s_nationkey AS STRING) || '.S' || CAST(s_suppkey AS STRING) || 'Service', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'bean' || CAST(s_suppkey * 2 AS STRING) END, 'beans.xml' FROM {supplier}""",
    "methods": """
SELECT * FROM (VALUES ('IOrderService', 'Get', 'int', true), ('IOrderService', 'Save', 'Order', true), ('OrderService', 'Get', 'int', false), ('OrderService', 'Get', 'string', false), ('OrderService', 'Save', 'Order', false), ('OrderDao', 'Find', 'int', false), ('StockService', 'Count', '', false), ('GenericDao', 'All', '', false), ('ItemServiceImpl', 'Run', '', false), ('app.OrderDataAccess', 'Run', '', false)) AS t(class_name, method_name, params, is_interface)
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 9 = 0 THEN 'Repo' ELSE 'Service' END, CASE s_suppkey % 3 WHEN 0 THEN 'FindOrder' WHEN 1 THEN 'CountStock' ELSE 'Run' END, 'int', false FROM {supplier}
UNION ALL SELECT 'IS' || CAST(s_suppkey AS STRING) || 'Service', CASE s_suppkey % 2 WHEN 0 THEN 'Run' ELSE 'CountStock' END, 'int', true FROM {supplier} WHERE s_suppkey % 4 < 3""",
    "bases": """
SELECT * FROM (VALUES ('OrderService', 'IOrderService', 0, 0, ''), ('OrderService', 'BaseService', 1, 0, 'Order'), ('BaseService', 'RootService', 0, 0, 'T'), ('StockService', 'BaseService', 0, 0, 'Stock'), ('OrderDao', 'BaseDaoNHB', 0, 0, 'Order'), ('OrderDao', 'BaseDaoNHB', 0, 1, 'long'), ('Loop', 'Loop2', 0, 0, ''), ('Loop2', 'Loop', 0, 0, ''),
 ('PairBase', 'RootPair', 0, 0, 'T2'), ('PairBase', 'RootPair', 0, 1, 'T1'), ('NamePair', 'PairBase', 0, 0, 'Name'), ('NamePair', 'PairBase', 0, 1, 'Value'), ('Orders', 'data.IOrders', 0, 0, '')) AS t(class_name, base_name, ord, arg, argument)
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service', CASE WHEN s_suppkey % 6 = 0 THEN 'lib.' ELSE '' END || 'IS' || CAST(s_suppkey AS STRING) || 'Service', 0, 0, '' FROM {supplier}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service', CASE s_suppkey % 4 WHEN 0 THEN 'BaseService' WHEN 1 THEN 'BaseBLL' WHEN 2 THEN 'IDBaseDao' ELSE 'PairBase' END, 1, 0, CASE WHEN s_suppkey % 8 = 5 THEN 'T' ELSE 'E' || CAST(s_suppkey % 7 AS STRING) END FROM {supplier}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service', 'PairBase', 1, 1, 'long' FROM {supplier} WHERE s_suppkey % 4 = 3""",
    "type_parameters": """
SELECT * FROM (VALUES ('BaseService', 'T', 0), ('RootService', 'T', 0), ('PairBase', 'T1', 0), ('PairBase', 'T2', 1), ('RootPair', 'A', 0), ('RootPair', 'B', 1), ('BaseDaoNHB', 'T', 0)) AS t(class_name, parameter, ord)""",
    "usings": """
SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service' AS class_name, 'ext.m' || CAST(s_suppkey % 3 AS STRING) || '.IS' || CAST(s_suppkey + s_suppkey % 2 AS STRING) || 'Service' AS name FROM {supplier} UNION ALL SELECT 'OrderService', 'System' FROM {region}""",
    "declared": """
SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service' AS class_name, '' AS method, 'field' AS scope, 'dao' AS name, 'BaseDao<E' || CAST(s_suppkey % 7 AS STRING) || ', long>' AS type FROM {supplier}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service', 'S' || CAST(s_suppkey AS STRING) || 'Service.Run', CASE WHEN s_suppkey % 2 = 0 THEN 'local' ELSE 'param' END, 'dao', CASE WHEN s_suppkey % 3 = 0 THEN 'Repo<Item>' WHEN s_suppkey % 3 = 1 THEN 'Repo<T>' ELSE 'Plain' END FROM {supplier} WHERE s_suppkey % 5 < 3""",
    "mappings": """
SELECT * FROM (VALUES ('Order', 'ORDERS', 'a.hbm.xml'), ('Order', 'T_ORDERS', 'b.hbm.xml'), ('Item', '', 'b.hbm.xml')) AS t(class_name, table_name, file)
UNION ALL SELECT 'E' || CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'T_E' || CAST(n_nationkey AS STRING) END, 'c.hbm.xml' FROM {nation} WHERE n_nationkey < 6""",
    "accesses": """
SELECT * FROM (VALUES (1, 'OrderDao.Find', 'session', 'Get', 'Order', '', 50), (2, 'OrderDao.All', 'hibernateSession', 'CreateQuery', '', 'from Order o where o.id = 1', 50), (3, 'OrderDao.Drop', 'session', 'CreateQuery', '', 'delete from Item', 50), (4, 'OrderDao.Trace', 'session', 'CreateQuery', '', 'hql', 50), (5, 'Other.Get', 'cache', 'Get', 'Order', '', 50),
 (6, 'StockDao.Up', 'Session', 'CreateSQLQuery', '', 'update Stock set n = 1', 50), (7, 'StockDao.Up', 'Session', 'CreateQuery', '', 'update Stock set n = 2', 60), (8, 'X.Y', 'session', 'Get', '', '', 10), (9, 'OrderDao.Trace', 'session', 'CreateQuery', '', 'hql', 95), (10, 'X.Z', 'session', 'Load', 'Order', '', 10)) AS t(access_id, method, receiver, api, generic, argument, pos)
UNION ALL SELECT CAST(100 + s_suppkey AS INT), 'S' || CAST(s_suppkey AS STRING) || 'Service.Run', CASE s_suppkey % 4 WHEN 0 THEN 'this.dao' WHEN 1 THEN 'dao' WHEN 2 THEN 'session' ELSE 'mySession' END, CASE s_suppkey % 3 WHEN 0 THEN 'Query' WHEN 1 THEN 'Save' ELSE 'CreateQuery' END,
 CASE WHEN s_suppkey % 5 = 0 THEN 'E' || CAST(s_suppkey % 7 AS STRING) ELSE '' END, CASE WHEN s_suppkey % 5 = 1 THEN 'from E' || CAST(s_suppkey % 7 AS STRING) || ' e' WHEN s_suppkey % 5 = 2 THEN 'q' ELSE '' END, CAST(10 + s_suppkey % 30 AS INT) FROM {supplier}""",
    "assignments": """
SELECT * FROM (VALUES ('OrderDao.Trace', 'hql', 10, 'from Order'), ('OrderDao.Trace', 'hql', 20, 'from Item i join Order'), ('OrderDao.Trace', 'hql', 90, 'from Late'), ('OrderDao.Trace', 'x', 30, 'from X')) AS t(method, variable, pos, expression)
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || 'Service.Run', 'q', CAST(5 + x.n * 12 AS INT), 'from E' || CAST((s_suppkey + x.n) % 7 AS STRING) FROM {supplier} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) x""",
    "facts": """
SELECT * FROM (VALUES ('routes', 'n1', 'route', 'a.cs', '/a'), ('routes', 'n2', 'route', 'b.cs', '/b'), ('orm', 'n1', 'access', 'a.cs', 'Order'), ('orm', 'n3', 'access', 'c.cs', 'Item'), ('routes', 'n1', 'route', 'd.cs', '/z')) AS t(analyzer, subject_id, fact_type, source_file, value)""",
    "evidence": """
SELECT statement_id, subject_id, statement_id || '/' || CAST(seq AS STRING) AS evidence_id, CAST(seq AS INT) AS seq, 'symbol:' || CAST(CAST(round(score * 100) AS INT) % 9 + seq AS STRING) AS symbol, 'file' || CAST((CAST(round(score * 100) AS INT) + seq) % 6 AS STRING) AS source_file,
       score * 0.9 AS score, CAST(seq AS INT) AS hop, speculative_ancestor FROM {statements} CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1) x WHERE hop > 0""",
    # what is left of it later, and the global chain, which misses some
    "later_evidence": """
SELECT * FROM {evidence} WHERE statement_id IN (SELECT statement_id FROM {later}) AND NOT (hop = 1 AND symbol = 'symbol:4')""",
    "chain": """
SELECT evidence_id FROM {evidence} WHERE symbol <> 'symbol:7'""",
    # states without violations: grounded statements of assistants, one tone and no opposites
    "calm": """
SELECT statement_id, subject_id, 'turn ' || statement_id AS claim, 'assistant' AS tone, 0.8 + score / 10 AS score, hop, false AS speculative_ancestor, false AS suppressed FROM {statements}""",
    "calm_evidence": """
SELECT statement_id, subject_id, statement_id || '/0' AS evidence_id, CAST(0 AS INT) AS seq, 'symbol:' || statement_id AS symbol, 'file0' AS source_file, CAST(0.9 AS DOUBLE) AS score, CAST(1 AS INT) AS hop, false AS speculative_ancestor FROM {calm}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the fixture as a DataFrame."""
    sql = VIEWS[name]
    named = {n: table(spark, sf_dir, n) if n in TABLES else view(spark, sf_dir, n) for n in _names(name)}
    return spark.sql(sql, **named)


@cache
def _names(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "nodes")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges")
