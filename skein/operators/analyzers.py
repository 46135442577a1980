"""Fact producers over tables of declarations: routes, beans, object mappings, generics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .retrieval import contained

#: Names of a session's methods that reach entities.
SESSION_APIS = ("Query", "Get", "Save", "Update", "Delete", "SaveOrUpdate", "CreateQuery", "CreateSQLQuery", "CreateCriteria")
#: Base types whose first argument is an entity.
ENTITY_BASES = ("BaseBLL", "IBGenericManager", "BaseDaoNHB", "HibernateDaoSupport", "IDBaseDao")
#: Endings of repository and service names, names of generic repositories, and of their interfaces.
REPOSITORY_SUFFIXES = ("Repository", "Repo", "Dao", "DAO", "Dal", "DataAccess", "DataProvider", "QueryProvider")
SERVICE_SUFFIXES = ("Service", "ServiceImpl", "Manager", "Handler", "Provider", "Processor", "Controller")
GENERIC_REPOSITORIES = (
    "Repository", "BaseRepository", "GenericRepository", "Dao", "BaseDao", "GenericDao", "BaseService", "GenericService",
    "CrudRepository", "PagingAndSortingRepository", "JpaRepository", "MongoRepository",
)
REPOSITORY_INTERFACES = ("IRepository", "IDao", "IReadRepository", "IWriteRepository", "ICrudService", "IEntityService")


def is_action() -> Column:
    controller = F.col("class_name").endswith("Controller") | F.col("base_type").isin("Controller", "ControllerBase")
    return controller & F.col("is_public") & ~F.col("is_static") & (F.col("attribute") != "NonAction")


def verb() -> Column:
    """By attribute, else by the first word of the method's name; GET otherwise."""
    a, m = F.col("attribute"), F.col("method_name")
    by_name = F.when(m.rlike("^Get([A-Z]|$)"), "GET").when(m.rlike("^(Post|Create)([A-Z]|$)"), "POST").when(m.rlike("^(Put|Update)([A-Z]|$)"), "PUT")
    by_name = by_name.when(m.rlike("^(Delete|Remove)([A-Z]|$)"), "DELETE").when(m.rlike("^Patch([A-Z]|$)"), "PATCH").otherwise("GET")
    return F.when(a.startswith("Http"), F.upper(F.substr(a, F.lit(5)))).otherwise(by_name)


def route() -> Column:
    """Class and method templates with tokens filled in; without any, /controller/action."""
    name = F.lower(F.regexp_replace("class_name", "Controller$", ""))
    both = F.concat_ws("/", F.nullif(F.btrim("class_route", F.lit("/")), F.lit("")), F.nullif(F.btrim("method_route", F.lit("/")), F.lit("")))
    both = F.when(both == "", F.concat_ws("/", name, F.lower("method_name"))).otherwise(both)
    filled = F.replace(F.replace(both, F.lit("[controller]"), name), F.lit("[action]"), F.lower("method_name"))
    return F.concat(F.lit("/"), F.rtrim(filled, F.lit("/")))


def routes(actions: DataFrame) -> DataFrame:
    """(class_name, method_name, verb, route) of controller actions."""
    return actions.filter(is_action()).select("class_name", "method_name", verb().alias("verb"), route().alias("route")).distinct()


def bean_edges(beans: DataFrame) -> DataFrame:
    """(from_type, to_type): property references between declared beans."""
    own = beans.select("type_name", "ref").distinct()
    target = beans.select(F.col("bean_id").alias("ref"), F.col("type_name").alias("to_type")).distinct()
    return own.join(target, "ref").select(F.col("type_name").alias("from_type"), "to_type").distinct()


def implementations(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(interface, class_name, method_name, params): interface methods and those that implement them."""
    wanted = methods.filter("is_interface").select(F.col("class_name").alias("base_name"), "method_name", "params")
    have = methods.filter("not is_interface").select("class_name", "method_name", "params")
    link = bases.filter(F.col("base_name").startswith("I")).select("class_name", "base_name")
    return link.join(wanted, "base_name").join(have, ["class_name", "method_name", "params"]).select(F.col("base_name").alias("interface"), "class_name", "method_name", "params")


def anchors(beans: DataFrame, methods: DataFrame) -> DataFrame:
    """(bean_id, anchor): the first method by name of each bean's class."""
    first = methods.groupBy("class_name").agg(F.min("method_name").alias("anchor"))
    return beans.select("bean_id", F.substring_index("type_name", ".", -1).alias("class_name")).distinct().join(first, "class_name", "left").select("bean_id", "anchor")


def last_mappings(mappings: DataFrame) -> DataFrame:
    """(class_name, table_name): the last file wins; an empty table name is the class with an s."""
    last = mappings.groupBy("class_name").agg(F.max_by("table_name", "file").alias("t"))
    return last.select("class_name", F.coalesce(F.nullif("t", F.lit("")), F.concat("class_name", F.lit("s"))).alias("table_name"))


def hql_entity(text: Column) -> Column:
    """The entity of a query: delete from, update, from, join, in this order."""
    one = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(one(r"(?i)delete\s+from\s+(\w+)"), one(r"(?i)update\s+(\w+)"), one(r"(?i)from\s+(\w+)"), one(r"(?i)join\s+(\w+)"))


def traced(accesses: DataFrame, assignments: DataFrame) -> DataFrame:
    """(access_id, expression): the last assignment of the argument's variable before its use (``pos`` of both)."""
    used = accesses.select("access_id", "method", F.col("argument").alias("variable"), F.col("pos").alias("used"))
    rows = used.join(assignments, ["method", "variable"]).filter("pos < used")
    return rows.groupBy("access_id").agg(F.max_by("expression", "pos").alias("expression"))


def entity_accesses(accesses: DataFrame, mappings: DataFrame, assignments: DataFrame) -> DataFrame:
    """(access_id, method, entity, table_name, confidence) of calls on sessions, with an entity."""
    calls = accesses.filter(F.lower("receiver").contains("session") & F.col("api").isin(*SESSION_APIS))
    rows = calls.join(traced(accesses, assignments), "access_id", "left")
    direct, by_text, by_trace = F.nullif("generic", F.lit("")), hql_entity(F.col("argument")), hql_entity(F.col("expression"))
    rows = rows.withColumn("entity", F.coalesce(direct, by_text, by_trace)).filter("entity is not null")
    rows = rows.join(last_mappings(mappings).withColumnRenamed("class_name", "entity"), "entity", "left")
    mapped, generic = F.col("table_name").isNotNull(), F.col("generic") != ""
    sure = F.when(mapped & generic, "exact").when(mapped, "high").when(generic, "medium").when(by_text.isNotNull(), "medium").otherwise("low")
    return rows.select("access_id", "method", "entity", F.coalesce("table_name", F.concat("entity", F.lit("s"))).alias("table_name"), sure.alias("confidence"))


def access_edges(found: DataFrame) -> DataFrame:
    """(method, to_id): distinct edges to entities, of medium confidence and more."""
    to = F.concat(F.lit("ext::entity::"), "entity", F.lit("::"), "table_name")
    return found.filter("confidence <> 'low'").select("method", to.alias("to_id")).distinct()


def base_chain(bases: DataFrame, depth: int = 10) -> DataFrame:
    """(class_name, ancestor, depth): all bases up the chain, each at its smallest depth; cycles end."""
    way = cut(bases.select(F.col("class_name").alias("src"), F.col("base_name").alias("dst")).distinct())
    seen = cut(way.select(F.col("src").alias("class_name"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth")))
    here = seen
    for d in range(2, depth + 1):
        up = here.join(way, here["ancestor"] == way["src"]).select("class_name", F.col("dst").alias("ancestor")).distinct()
        here = cut(up.join(seen.select("class_name", "ancestor"), ["class_name", "ancestor"], "left_anti").filter("class_name <> ancestor").withColumn("depth", F.lit(d)))
        if here.isEmpty():
            break
        seen = cut(seen.unionByName(here))
    return seen


def bindings(bases: DataFrame, parameters: DataFrame, depth: int = 10) -> DataFrame:
    """(class_name, base_name, arg, argument, depth): arguments of bases, parameters replaced by what binds them at their place.

    ``bases``: (class_name, base_name, arg, argument), a row an argument; ``parameters``: (class_name, parameter, ord).
    """
    direct = bases.filter("argument <> ''").select("class_name", "base_name", "arg", "argument")
    own = parameters.select("class_name", F.col("parameter").alias("argument"), F.col("ord").alias("at"))
    # what a class passes on: its parameter at ``at`` is argument ``arg`` of its base
    inner = cut(direct.join(own, ["class_name", "argument"]).select(F.col("class_name").alias("mid"), "at", F.col("base_name").alias("top"), F.col("arg").alias("top_arg")))
    seen = cut(direct.withColumn("depth", F.lit(1)))
    here, key = seen, ["class_name", "base_name", "arg", "argument"]
    for d in range(2, depth + 1):
        up = here.join(inner, (here["base_name"] == inner["mid"]) & (here["arg"] == inner["at"]))
        up = up.select("class_name", F.col("top").alias("base_name"), F.col("top_arg").alias("arg"), "argument", F.lit(d).alias("depth")).distinct()
        here = cut(up.join(seen.select(*key), key, "left_anti"))
        if here.isEmpty():
            break
        seen = cut(seen.unionByName(here))
    return seen.filter(~F.col("argument").rlike(r"^T\d*$"))


def generic_arguments(bases: DataFrame, parameters: DataFrame) -> DataFrame:
    """(class_name, base_name, parameter, argument, confidence): every argument under the parameter it fills.

    Exact as written, high through a chain of bases, medium where it is a parameter still.
    """
    bound = bindings(bases, parameters).withColumn("confidence", F.when(F.col("depth") == 1, "exact").otherwise("high")).drop("depth")
    loose = bases.filter(F.col("argument").rlike(r"^T\d*$")).select("class_name", "base_name", "arg", "argument", F.lit("medium").alias("confidence"))
    own = parameters.select(F.col("class_name").alias("base_name"), "parameter", F.col("ord").alias("arg"))
    return bound.unionByName(loose).join(own, ["base_name", "arg"], "left").select("class_name", "base_name", F.coalesce("parameter", F.lit("")).alias("parameter"), "argument", "confidence").distinct()


def interface_namespaces(bases: DataFrame, usings: DataFrame, beans: DataFrame) -> DataFrame:
    """(class_name, interface, namespace): where the interfaces of beans' classes live.

    As written if qualified, else by the class's ``usings`` (class_name, name) that end with the interface, the first of them, else
    the bean's own namespace. ``beans``: (bean_id, type_name).
    """
    own = beans.select(F.substring_index("type_name", ".", -1).alias("class_name"), F.regexp_replace("type_name", r"\.?[^.]*$", "").alias("home")).distinct()
    before = lambda c: F.regexp_replace(c, r"\.?[^.]*$", "")
    rows = bases.select("class_name", F.col("base_name").alias("written"), F.substring_index("base_name", ".", -1).alias("interface")).distinct().filter(F.col("interface").startswith("I"))
    named = usings.filter(F.col("name").contains(".")).groupBy("class_name", F.substring_index("name", ".", -1).alias("interface")).agg(F.min(before(F.col("name"))).alias("used"))
    found = rows.join(own, "class_name").join(named, ["class_name", "interface"], "left")
    return found.select("class_name", "interface", F.when(F.col("written").contains("."), before(F.col("written"))).otherwise(F.coalesce("used", "home")).alias("namespace")).distinct()


def typed_invocations(invocations: DataFrame, declared: DataFrame) -> DataFrame:
    """(method, expression, entity): calls on receivers whose declared type has an entity argument, once each.

    ``declared``: (class_name, method, scope, name, type) of fields (method ''), locals and parameters; a parameter hides a local, a
    local a field. ``invocations``: (method, class_name, receiver, api).
    """
    rank = F.when(F.col("scope") == "param", 3).when(F.col("scope") == "local", 2).otherwise(1)
    known = declared.select("class_name", F.col("method").alias("of"), F.col("name").alias("receiver"), "type", rank.alias("rank"))
    own = F.col("receiver").startswith("this.").alias("own")  # a field, whatever hides it
    rows = invocations.select("method", "class_name", "api", own, F.regexp_replace("receiver", r"^this\.", "").alias("receiver")).distinct()
    rows = rows.join(known, ["class_name", "receiver"]).filter((F.col("of") == "") | (F.col("of") == F.col("method")) & ~F.col("own"))
    best = rows.groupBy("method", "own", "receiver", "api").agg(F.max_by("type", F.struct("rank", "type")).alias("type"))
    found = best.select("method", F.concat_ws(".", "receiver", "api").alias("expression"), first_argument(F.col("type")).alias("entity"))
    return found.filter((F.col("entity") != "") & ~F.col("entity").rlike(r"^T\d*$")).distinct()


def dao_call_sites(invocations: DataFrame, declared: DataFrame) -> DataFrame:
    """(access_id, dao, entity): calls on fields whose type is a data access object, by ``field`` or ``this.field``."""
    fields = declared.filter((F.col("scope") == "field") & F.lower("type").contains("basedao")).select("class_name", F.col("name").alias("receiver"), F.col("type").alias("dao"))
    rows = invocations.withColumn("receiver", F.regexp_replace("receiver", r"^this\.", "")).join(fields, ["class_name", "receiver"])
    return rows.select("access_id", "dao", first_argument(F.col("dao")).alias("entity"))


def entity_registry(bases: DataFrame) -> DataFrame:
    """(class_name, entity, role): classes over a known base, by its first concrete argument."""
    role = F.when(F.col("base_name").isin("BaseBLL", "IBGenericManager"), "bll").otherwise("dao")
    rows = bases.filter(F.col("base_name").isin(*ENTITY_BASES) & (F.col("argument") != "") & ~F.col("argument").rlike(r"^T\d*$"))
    return rows.groupBy("class_name").agg(F.min_by("argument", F.struct("ord", "arg")).alias("entity"), F.min(role).alias("role"))


def name_pattern(name: Column) -> Column:
    """(kind, entity) that a class's name tells, null if none: generic repositories, their interfaces, endings of repositories and services.

    Case does not matter; what stands before the ending, without Impl, is the entity.
    """
    simple = F.substring_index(name, ".", -1)
    low, entity = F.lower(simple), F.lit(None).cast("string")
    result = lambda kind, of=entity: F.struct(F.lit(kind).alias("kind"), of.alias("entity"))
    lower = lambda names: [n.lower() for n in names]
    out = F.when(low.isin(*lower(GENERIC_REPOSITORIES)), result("generic-repository"))
    out = out.when(low.startswith("i") & F.substr(low, F.lit(2)).isin(*lower(GENERIC_REPOSITORIES)) & simple.startswith("I"), result("generic-repository-interface"))
    out = out.when(low.isin(*lower(REPOSITORY_INTERFACES)), result("interface-repository"))
    for kind, suffixes in (("repository-suffix", REPOSITORY_SUFFIXES), ("service-suffix", SERVICE_SUFFIXES)):
        for s in suffixes:
            before = F.regexp_replace(F.substr(simple, F.lit(1), F.length(simple) - len(s)), "(?i)Impl$", "")
            out = out.when(low.endswith(s.lower()), result(f"{kind}:{s}", F.when(F.length(simple) > len(s), before)))
    return out


def first_argument(type_name: Column) -> Column:
    """The first generic argument of a type, with what is nested in it."""
    inner = F.regexp_extract(type_name, r"^[^<]*<(.*)>$", 1)
    chars = F.split(inner, "")

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        done = s["done"] | ((c == ",") & (s["depth"] == 0))
        return F.struct(depth.alias("depth"), done.alias("done"), F.when(done, s["text"]).otherwise(F.concat(s["text"], c)).alias("text"))

    return F.trim(F.aggregate(chars, F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("text")), step)["text"])


def by_priority(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The candidate of the smallest priority of each key, then the smallest entity."""
    place = F.row_number().over(W.partitionBy(*by).orderBy("priority", "entity"))
    return candidates.withColumn("r", place).filter("r = 1").drop("r")


def name_hints(methods: DataFrame, entities: DataFrame) -> DataFrame:
    """(class_name, method_name, entity): entities whose name stands in a method's or its class's."""
    names = methods.select("class_name", "method_name").distinct()
    by = names.select("class_name", "method_name", F.explode(F.array_distinct(F.array(F.lower("method_name"), F.lower("class_name")))).alias("l"))
    low = entities.select("entity", F.lower("entity").alias("s"))
    return contained(low.select("s").distinct(), by.select("l").distinct()).join(low, "s").join(by, "l").select("class_name", "method_name", "entity").distinct()


def resolution_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("method").alias("n_methods"), F.min("table_name").alias("table_name"))


def diagnostics(found: DataFrame, mappings: DataFrame, accesses: DataFrame) -> DataFrame:
    """(problem, subject): entities mapped twice, accesses without an entity, entities without a mapping."""
    twice = mappings.groupBy("class_name").count().filter("count > 1").select(F.lit("duplicate-mapping").alias("problem"), F.col("class_name").alias("subject"))
    sessions = accesses.filter(F.lower("receiver").contains("session"))
    lost = sessions.join(found.select("access_id"), "access_id", "left_anti").select(F.lit("unresolved"), F.col("access_id").cast("string"))
    bare = found.select(F.col("entity").alias("class_name")).distinct().join(mappings, "class_name", "left_anti").select(F.lit("unmapped"), "class_name")
    return twice.union(lost).union(bare)
