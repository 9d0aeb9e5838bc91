"""HTTP and Kafka boundaries as joins over Java facts, OpenAPI operations and configuration scalars.

Nothing is guessed: an expression that no literal, constant, binding or registration resolves stays unresolved, several
candidates stay ambiguous. All joins are by repository and name; class and constant facts are pre-aggregated, so that a
name that occurs everywhere meets its key once per repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..tables import written
from .relational import align_payloads, suffix_match

_TEST_TREE = r"(^|/)src/(test|it)/|(^|/)test/"


def is_runtime(path: Column) -> Column:
    """Not below src/test, src/it or test."""
    return ~path.rlike(_TEST_TREE)


def java_facts(facts: DataFrame, kind: str, schema: str) -> DataFrame:
    """Facts of one kind from runtime sources with their values as columns."""
    rows = facts.filter((F.col("section") == "java_facts") & (F.col("family_kind") == kind) & is_runtime(F.col("path")))
    place = ["repo_id", "file_id", "path", "scope", "line_start", "line_end", "column_start", "column_end"]
    v = F.from_json("extra_json", schema).alias("v")
    return rows.select(*[F.col(c).alias("at_" + c if c == "path" else c) for c in place], v).select(*["at_path" if c == "path" else c for c in place], "v.*")


def config_scalars(facts: DataFrame) -> DataFrame:
    """Distinct (key, value) scalars of JSON and YAML files per repository."""
    s = facts.filter("section = 'scalar_properties'")
    return s.select("repo_id", F.col("family_label").alias("key"), F.get_json_object("extra_json", "$.value").alias("value")).distinct()


def _substitute(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """``rows`` (repo_id, keys, parts) with references to ``known`` constants replaced by their parts."""
    each = rows.select("repo_id", *keys, F.posexplode("parts").alias("i", "p"))
    ref = F.col("p")[0] == "ref"
    named = each.select("*", F.when(ref, F.col("p")[1]).alias("of"), F.when(ref, F.col("p")[2]).alias("called"))
    subs = known.select("repo_id", F.col("_owner").alias("of"), F.col("_name").alias("called"), F.col("parts").alias("sub"))
    got = named.join(subs, ["repo_id", "of", "called"], "left").select("repo_id", *keys, "i", F.coalesce("sub", F.array("p")).alias("sub"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "sub"))), lambda x: x["sub"]))
    return got.groupBy("repo_id", *keys).agg(flat.alias("parts"))


#: Bytes of a string constant in a class file, at most; a fold beyond it is none.
MAX_CONSTANT = 65_535


def _split_at_ref(parts: Column) -> list[Column]:
    """Text before the one reference of ``parts``, what it refers to, and the text after it."""
    at = F.array_position(F.transform(parts, lambda p: p[0]), "ref").cast("int")
    text = lambda some: F.array_join(F.transform(some, lambda p: p[1]), "")
    ref = F.get(parts, at - 1)
    return [text(F.slice(parts, 1, F.greatest(at - 1, F.lit(0)))).alias("before"), ref[1].alias("of"), ref[2].alias("called"), text(F.slice(parts, at + 1, F.size(parts))).alias("after")]


def _contract(chain: DataFrame) -> DataFrame:
    """Constants that are text around one other constant, each led on to the end of its chain.

    Every round joins each with what it points to, so that pointers double: a chain of n takes about log2(n) rounds. Those of a
    cycle never arrive; they are left after as many rounds as the longest chain could take.
    """
    chain = written(chain, "chains")
    for _ in range(max(1, chain.count()).bit_length()):
        to = chain.select("repo_id", F.col("_owner").alias("of"), F.col("_name").alias("called"), F.col("before").alias("b2"), F.col("of").alias("o2"), F.col("called").alias("c2"), F.col("after").alias("a2"))
        got = chain.join(to, ["repo_id", "of", "called"], "left")
        moved = F.col("o2").isNotNull()
        got = got.select("repo_id", "_owner", "_name", F.when(moved, F.concat("before", "b2")).otherwise(F.col("before")).alias("before"), F.coalesce("o2", "of").alias("of"), F.when(moved, F.col("c2")).otherwise(F.col("called")).alias("called"), F.when(moved, F.concat("a2", "after")).otherwise(F.col("after")).alias("after"), moved.alias("moved"))
        got = written(got.filter(F.octet_length("before") + F.octet_length("after") <= MAX_CONSTANT), "chains")
        chain = got.drop("moved")
        if got.filter("moved").isEmpty():
            break
    return chain


def resolve_constants(constants: DataFrame) -> DataFrame:
    """String constants that fold to one text: repo_id, _owner, _name, parts (the text as one literal).

    A constant with differing declarations, a missing one or a cycle has none. Constants around one other are led to the end of
    their chains by pointer jumping (``_contract``); those of several are put together where all of these are known, and may leave new
    chains behind. So the rounds follow how often constants of several parts stand in one another, not how long chains are.
    """
    agreed = constants.groupBy("repo_id", F.col("owner").alias("_owner"), F.col("name").alias("_name")).agg(F.count_distinct("expression").alias("n"), F.min("expression").alias("parts"))
    refs = F.size(F.filter("parts", lambda p: p[0] == "ref"))
    one = written(agreed.filter("n = 1").drop("n").withColumn("refs", refs), "constants")
    literal = lambda text: F.array(F.array(F.lit("lit"), text)).alias("parts")
    key = ["repo_id", "_owner", "_name"]
    known = one.filter("refs = 0").select(*key, literal(F.array_join(F.transform("parts", lambda p: p[1]), "")))
    chain = one.filter("refs = 1").select(*key, *_split_at_ref(F.col("parts")))
    many = one.filter("refs > 1").drop("refs")
    while True:
        if not chain.isEmpty():
            end = known.select("repo_id", F.col("_owner").alias("of"), F.col("_name").alias("called"), F.col("parts")[0][1].alias("text"))
            got = written(_contract(chain).join(end, ["repo_id", "of", "called"], "left"), "constants")
            known = known.unionByName(got.filter("text is not null").select(*key, literal(F.concat("before", "text", "after"))))
            chain = got.filter("text is null").drop("text")
        if many.isEmpty():
            break
        put = written(_substitute(many, ["_owner", "_name"], known).withColumn("refs", refs), "constants")
        if put.filter("refs < 2").isEmpty():
            break
        known = known.unionByName(put.filter("refs = 0").select(*key, literal(F.array_join(F.transform("parts", lambda p: p[1]), ""))))
        chain = chain.unionByName(put.filter("refs = 1").select(*key, *_split_at_ref(F.col("parts"))).select(chain.columns))
        many = put.filter("refs > 1").drop("refs")
    return written(known, "constants")


def fold_constants(known: DataFrame, expressions: DataFrame, keys: list[str]) -> DataFrame:
    """``expressions`` (keys, parts array<array<string>>) with ``value``: the string they fold to by ``resolve_constants``, or null."""
    rows = written(_substitute(expressions, keys, known), "expressions")
    done = F.forall("parts", lambda p: p[0] == "lit")
    return rows.select("repo_id", *keys, F.when(done, F.array_join(F.transform("parts", lambda p: p[1]), "")).alias("value"))


def string_constants(facts: DataFrame) -> DataFrame:
    """What ``resolve_constants`` makes of a build's facts; routes, registrations and topics share it."""
    return resolve_constants(java_facts(facts, "string_constant", "name string, owner string, expression array<array<string>>").select("repo_id", "owner", "name", "expression"))


def class_fields(facts: DataFrame) -> DataFrame:
    """Per class name: its fields if all declarations agree, with the status of what is known."""
    c = java_facts(facts, "class_fields", "name string, fields array<struct<name:string,collection:string>>").filter("name is not null")
    g = c.groupBy("repo_id", F.col("name").alias("payload")).agg(F.count_distinct("fields").alias("n"), F.min("fields").alias("fields"))
    return g.select("repo_id", "payload", F.when(F.col("n") == 1, F.to_json("fields")).alias("payload_fields"), F.when(F.col("n") == 1, "available_local_declaration").otherwise("ambiguous_local_declarations").alias("payload_fields_status"))


def with_fields(rows: DataFrame, fields: DataFrame) -> DataFrame:
    out = rows.join(fields, ["repo_id", "payload"], "left")
    return out.withColumn("payload_fields_status", F.when(F.col("payload").isNull(), "unresolved_payload").otherwise(F.coalesce("payload_fields_status", F.lit("unavailable_external_declaration"))))


#: The whole of what a boundary carries.
_SIDES = [f"{side}_{what}" for side in ("request", "response") for what in ("payload", "status", "fields")]


def with_sides(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """``rows`` with status and fields of their request_payload and response_payload by local declarations; nulls where there is no payload."""
    for side in ("request", "response"):
        f = fields.select("repo_id", F.col("payload").alias(f"{side}_payload"), F.col("payload_fields").alias(f"{side}_fields"), F.col("payload_fields_status").alias("_status"))
        rows = rows.join(f, ["repo_id", f"{side}_payload"], "left")
        rows = rows.withColumn(f"{side}_status", F.when(F.col(f"{side}_payload").isNotNull(), F.coalesce("_status", F.lit("unavailable_external_declaration")))).drop("_status")
    return rows


def with_main_side(rows: DataFrame, first: str) -> DataFrame:
    """``payload`` and its fields and status from the ``first`` side, or where that has no payload all from the other."""
    other = "request" if first == "response" else "response"
    pick = lambda what: F.when(F.col(f"{first}_payload").isNotNull(), F.col(f"{first}_{what}")).otherwise(F.col(f"{other}_{what}"))
    return rows.withColumns({"payload": pick("payload"), "payload_fields": pick("fields"), "payload_fields_status": F.coalesce(pick("status"), F.lit("unresolved_payload"))})


_PLACE = ["repo_id", "file_id", "at_path", "scope", "line_start", "line_end", "column_start", "column_end"]


def resolve_paths(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """Path expressions by literal, or by a value binding of the same file and the configuration it names.

    A binding's key matches the configuration key that equals it or ends with a dot and it. Only values that start with
    a slash are paths: none, one or several leave it unresolved, resolved or ambiguous.
    """
    bind = java_facts(facts, "value_binding", "name string, property_key string").select("repo_id", "at_path", F.col("name").alias("symbol"), "property_key")
    # an expression that starts with # names its configuration suffix itself
    own = calls.filter(F.col("expression").startswith("#")).select("repo_id", "at_path", F.col("expression").alias("symbol"), F.expr("substring(expression, 2)").alias("property_key"))
    bind = bind.unionByName(own).distinct()
    scalars = config_scalars(facts).filter(F.col("value").startswith("/"))
    wanted = bind.select(F.col("repo_id").alias("r"), "property_key").distinct()
    values = suffix_match(wanted, "property_key", scalars, "key", S.dotted_suffixes).filter("r = repo_id").groupBy("repo_id", "property_key").agg(F.array_sort(F.collect_set("value")).alias("candidates"))
    bound = bind.join(values, ["repo_id", "property_key"], "left").groupBy("repo_id", "at_path", "symbol").agg(
        F.array_sort(F.collect_set("property_key")).alias("property_keys"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"))
    c = calls.withColumn("symbol", F.when(F.col("expression").startswith("#"), F.col("expression")).otherwise(S.symbol(F.col("expression")))).join(bound, ["repo_id", "at_path", "symbol"], "left")
    lit, n = S.literal_string(F.col("expression")), F.size("candidates")
    none = F.array().cast("array<string>")
    status = F.when(lit.isNotNull(), "resolved").when(F.col("property_keys").isNull(), "unresolved_expression").when(n == 1, "resolved").when(n > 1, "ambiguous_declared_config").otherwise("unresolved_property")
    basis = F.when(lit.isNotNull(), "string_literal").when(F.col("property_keys").isNull(), "unresolved_expression").otherwise("value_binding")
    return c.withColumns({
        "path_status": status, "resolution": basis, "path": F.when(lit.isNotNull(), lit).when(n == 1, F.col("candidates")[0]),
        "path_candidates": F.when(lit.isNotNull(), F.array(lit)).otherwise(F.coalesce("candidates", none)), "property_keys": F.coalesce("property_keys", none),
        "confidence": F.when(status == "ambiguous_declared_config", 0.5).otherwise(1.0),
    }).drop("symbol", "candidates")


def outbound_http(facts: DataFrame) -> DataFrame:
    """Outbound calls: direct exchanges, and call sites of one-hop wrappers in place of the exchange inside them."""
    ex = java_facts(facts, "exchange", "name string, method string, path string, response string, body_type string, parameter int, parameters int").withColumnRenamed("path", "expression")
    direct = ex.filter("parameter is null")
    wrap = ex.filter("parameter is not null").groupBy("repo_id", "name", "parameters").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("method", "parameter", "response")]).filter("n = 1").drop("n")
    inv = java_facts(facts, "invocation", "name string, arguments array<string>").withColumn("parameters", F.size("arguments"))
    sites = inv.join(wrap, ["repo_id", "name", "parameters"]).withColumn("expression", F.get("arguments", F.col("parameter")))
    cols = [*_PLACE, "method", "expression", "request", "response"]
    none = F.lit(None).cast("string")
    jdk = java_facts(facts, "jdk_http", "method string, path string, suffix string, request string, response string")
    jdk = jdk.withColumns({"expression": F.coalesce("path", F.concat(F.lit("#"), "suffix"), F.lit(""))})
    rows = resolve_paths(direct.withColumn("request", none).select(*cols).unionByName(sites.withColumn("request", none).select(*cols)).unionByName(jdk.select(*cols)), facts)
    rows = rows.withColumns({"request_payload": S.payload_type(F.col("request")), "response_payload": S.payload_type(F.col("response"))}).drop("request")
    return with_main_side(with_sides(rows, class_fields(facts)), "response").withColumns({"direction": F.lit("outbound"), "source": F.lit("java")})


def inbound_http(facts: DataFrame, consts: DataFrame | None = None) -> DataFrame:
    """Inbound operations: OpenAPI, and Java routes below the prefix their service is registered at.

    Rows of one repository, method and resolved path take one whole description of what is carried: the only one of their
    OpenAPI operations, else the only one there is; where several differ each row keeps its own. ``consts``: the ``string_constants``
    of the facts, if they are known.
    """
    consts = string_constants(facts) if consts is None else consts
    route = java_facts(facts, "route", "name string, owner string, interfaces array<string>, method string, expression array<array<string>>")
    reg = java_facts(facts, "registration", "service_type string, expression array<array<string>>")
    prefix = fold_constants(consts, reg.select("repo_id", "service_type", F.col("expression").alias("parts")).distinct().withColumn("k", F.to_json("parts")), ["service_type", "k"]).filter("value is not null")
    prefixes = prefix.groupBy("repo_id", F.col("service_type").alias("iface")).agg(F.array_sort(F.collect_set("value")).alias("prefixes"))
    keys = ["owner", "name", "method", "k"]
    route = route.withColumn("k", F.to_json("expression"))
    value = fold_constants(consts, route.select("repo_id", *keys, F.col("expression").alias("parts")).distinct(), keys)
    route = route.join(value, ["repo_id", *keys])
    own = route.select("repo_id", "owner", F.explode(F.array_union("interfaces", F.array("owner"))).alias("iface")).distinct()
    found = own.join(prefixes, ["repo_id", "iface"]).groupBy("repo_id", "owner").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("prefixes")))).alias("prefixes"))
    r = route.join(found, ["repo_id", "owner"], "left").withColumn("prefixes", F.coalesce("prefixes", F.array(F.lit(""))))
    paths = F.transform("prefixes", lambda p: S.join_http_path(p, F.col("value")))
    status = F.when(F.col("value").isNull(), "unresolved_expression").when(F.size("prefixes") > 1, "ambiguous_service_prefix").otherwise("resolved")
    none = F.array().cast("array<string>")
    java = r.select(
        *_PLACE, "method", F.when(status == "resolved", paths[0]).alias("path"), status.alias("path_status"), F.when(F.col("value").isNull(), none).otherwise(paths).alias("path_candidates"),
        F.lit(None).cast(_CARRIED).alias("carried"), F.lit("java").alias("source"),
    )
    op = facts.filter("section = 'http_facts' and family_kind = 'openapi_operation'")
    side = "struct<type:string,status:string,fields:array<struct<name:string,declared_type:string,collection:string,required:boolean>>>"
    v = F.from_json("extra_json", f"method string, path string, request {side}, response {side}")
    each = lambda k: (F.col(f"v.{k}.type").alias(f"{k}_payload"), F.col(f"v.{k}.status").alias(f"{k}_status"), F.to_json(f"v.{k}.fields").alias(f"{k}_fields"))
    carried = F.when(F.coalesce("v.request.type", "v.response.type").isNotNull(), F.struct(*each("request"), *each("response")))
    api = op.withColumn("v", v).select(
        "repo_id", "file_id", F.col("path").alias("at_path"), "scope", "line_start", "line_end", "column_start", "column_end", "v.method", "v.path", F.lit("resolved").alias("path_status"), F.array("v.path").alias("path_candidates"),
        carried.alias("carried"), F.lit("openapi").alias("source"),
    )
    both = java.unionByName(api)
    # rows without a resolved path have no path and so no siblings
    keyed = align_payloads(both, ["repo_id", "method", "path"], "carried", F.col("source") == "openapi")
    return with_main_side(keyed.select("*", "aligned_carried.*").drop("carried", "aligned_carried"), "request").withColumn("direction", F.lit("inbound"))


_CARRIED = "struct<" + ",".join(f"{c}:string" for c in _SIDES) + ">"


def listener_topics(listeners: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, owner, topics, enum_topic, chain_status) for listeners whose topic is an accessor of an enum constant.

    The chain: the class hands one enum constant to its superclass; that constant and its enum are declared once; the
    enum's constructor takes its final fields in order; the topic names one accessor, the accessor one of these fields; the
    constant's argument in the field's place is a constant with one literal, the key. The status is ``resolved``, or
    says which link is missing or not unique.
    """
    x = listeners.select("repo_id", "owner", "topics").distinct()
    refs = java_facts(facts, "super_enum_ref", "name string, owner string, enum string").groupBy("repo_id", "owner").agg(
        F.count_distinct("enum", "name").alias("refs"), F.min(F.struct("enum", "name")).alias("ref"))
    enums = java_facts(facts, "class_fields", "name string, type_kind string, annotations array<string>, fields array<struct<name:string,final:boolean>>").filter("type_kind = 'enum'")
    enums = enums.groupBy("repo_id", F.col("name").alias("enum")).agg(
        F.count(F.lit(1)).alias("enums"), F.max(F.array_contains("annotations", "RequiredArgsConstructor")).alias("in_order"), F.min(F.expr("filter(fields, x -> x.final).name")).alias("names"))
    access = java_facts(facts, "enum_accessor", "name string, owner string, field string")
    access = access.groupBy("repo_id", F.col("owner").alias("enum")).agg(F.collect_set(F.struct("name", "field")).alias("accessors"))
    each = java_facts(facts, "enum_constant", "name string, owner string, arguments array<string>")
    literals = F.array_distinct(F.filter(F.transform("arguments", S.literal_string), lambda v: v.isNotNull()))
    consts = each.groupBy("repo_id", F.col("owner").alias("enum"), F.col("name").alias("constant")).agg(F.count(F.lit(1)).alias("constants"), F.min("arguments").alias("arguments"))
    keyed = each.withColumn("keys", literals)
    # a constant is named with its enum, or alone where only one enum has it
    dotted = keyed.groupBy("repo_id", F.concat_ws(".", "owner", "name").alias("named")).agg(F.count(F.lit(1)).alias("n"), F.min("keys").alias("keys"))
    alone = keyed.groupBy("repo_id", F.col("name").alias("named")).agg(F.count(F.lit(1)).alias("n"), F.min("keys").alias("keys"))
    keys = dotted.unionByName(alone).filter((F.col("n") == 1) & (F.size("keys") == 1)).select("repo_id", "named", F.col("keys")[0].alias("enum_topic"))
    x = x.join(refs, ["repo_id", "owner"], "left").withColumns({"enum": F.col("ref.enum"), "constant": F.col("ref.name")}).drop("ref")
    x = x.join(consts, ["repo_id", "enum", "constant"], "left").join(enums, ["repo_id", "enum"], "left").join(access, ["repo_id", "enum"], "left")
    x = x.withColumn("called", F.filter("accessors", lambda a: F.contains(F.col("topics"), F.concat(F.lit("."), a["name"], F.lit("(")))))
    x = x.withColumn("place", F.array_position("names", F.try_element_at("called", F.lit(1))["field"]).cast("int"))
    x = x.withColumn("argument", F.get("arguments", F.col("place") - 1))
    x = x.withColumn("named", F.regexp_extract("argument", r"((?:[\w$]+\.)?[\w$]+)$", 1)).join(keys, ["repo_id", "named"], "left")
    ladder = [
        (F.coalesce("refs", F.lit(0)) != 1, "unresolved_constructor_binding"), ((F.coalesce("constants", F.lit(0)) != 1) | (F.coalesce("enums", F.lit(0)) != 1), "unresolved_enum_binding"),
        (~F.col("in_order"), "unresolved_enum_constructor_semantics"), (F.coalesce(F.size("called"), F.lit(0)) != 1, "unresolved_listener_topic_accessor"),
        (F.coalesce("place", F.lit(0)) == 0, "unresolved_enum_field_position"), (F.col("argument").isNull(), "unresolved_enum_argument_position"), (F.col("enum_topic").isNull(), "unresolved_config_key_reference"),
    ]
    status = F.when(ladder[0][0], ladder[0][1])
    for test, name in ladder[1:]:
        status = status.when(test, name)
    x = x.withColumn("chain_status", status.otherwise("resolved"))
    return x.select("repo_id", "owner", "topics", F.when(F.col("chain_status") == "resolved", F.col("enum_topic")).alias("enum_topic"), "chain_status")


def kafka(facts: DataFrame, consts: DataFrame | None = None) -> DataFrame:
    """Kafka boundaries. A listener's literal topics win unless they are expressions; such an expression is resolved
    through the enum constant that the class hands to its superclass, if the chain is unique; a published topic is a
    literal, a constant, or the configuration key bound to the symbol."""
    listen = java_facts(facts, "kafka_listener", "name string, owner string, topics string, payloads array<string>")
    plain = F.col("topics").isNotNull() & ~F.contains("topics", F.lit("#{")) & ~F.contains("topics", F.lit("${"))
    key = F.regexp_extract(F.coalesce("topics", F.lit("")), r"^\$\{([^:${}]+)\}$", 1)
    listen = listen.join(listener_topics(listen.filter("topics is not null"), facts), ["repo_id", "owner", "topics"], "left")
    found = F.coalesce(F.when(key != "", key), "enum_topic")
    gap = F.when(plain | found.isNotNull(), F.lit(None)).otherwise(F.coalesce("chain_status", F.lit("unresolved_expression")))
    consume = listen.select(
        *_PLACE, F.lit("consume").alias("direction"), F.when(plain, F.col("topics")).otherwise(found).alias("topic"),
        F.when(plain, "literal").when(found.isNotNull(), "config_key").alias("topic_kind"), F.when(F.size(F.array_distinct("payloads")) == 1, F.col("payloads")[0]).alias("payload"),
        gap.alias("gap"),
    )
    pub = java_facts(facts, "kafka_publish", "name string, owner string, topic string, topic_expression array<array<string>>, payload string")
    consts = string_constants(facts) if consts is None else consts
    pub = pub.withColumn("k", F.to_json("topic_expression"))
    folded = fold_constants(consts, pub.filter("topic_expression is not null").select("repo_id", "k", F.col("topic_expression").alias("parts")).distinct(), ["k"])
    bind = java_facts(facts, "value_binding", "name string, property_key string").groupBy("repo_id", "at_path", F.col("name").alias("symbol")).agg(F.array_sort(F.collect_set("property_key")).alias("keys"))
    p = pub.withColumn("symbol", S.symbol(F.col("topic"))).join(folded, ["repo_id", "k"], "left").join(bind, ["repo_id", "at_path", "symbol"], "left")
    one = F.size("keys") == 1
    publish = p.select(
        *_PLACE, F.lit("publish").alias("direction"), F.coalesce("value", F.when(one, F.col("keys")[0])).alias("topic"),
        F.when(F.col("value").isNotNull(), "literal").when(one, "config_key").alias("topic_kind"), S.payload_type(F.col("payload")).alias("payload"),
        F.lit(None).cast("string").alias("gap"),
    )
    rows = consume.unionByName(publish)
    rows = rows.withColumn("topic_status", F.when(F.col("topic").isNotNull(), "resolved").otherwise(F.coalesce("gap", F.lit("unresolved_expression")))).drop("gap")
    return with_fields(rows, class_fields(facts))


def as_observations(rows: DataFrame, protocol: str) -> DataFrame:
    """Boundaries in the shape of facts; parser mechanics are no part of the descriptor."""
    label = "path" if protocol == "http" else "topic"
    d = ["direction", "method", "path", "path_status", "path_candidates", *_SIDES] if protocol == "http" else ["direction", "topic", "topic_kind", "topic_status", "payload", "payload_fields"]
    # what the row rests on, for its family's provenance
    names = [c for c in ("source", "resolution", "topic_kind") if c in rows.columns]
    basis = [F.concat_ws("_", *[F.col(c) for c in names]).alias("basis"), F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence") if "confidence" in rows.columns else F.lit(1.0).alias("confidence")]
    desc = F.to_json(F.struct(F.lit(protocol).alias("protocol"), *[F.col(c) for c in d]), {"ignoreNullFields": "false"})
    return rows.select(
        "repo_id", "file_id", F.col("at_path").alias("path"), "scope", F.lit("boundaries").alias("section"), F.lit(f"{protocol}_boundary_observation").alias("family_kind"),
        F.coalesce(label, F.lit(f"{protocol}_boundary_observation")).alias("family_label"), desc.alias("descriptor_json"), F.lit(None).cast("string").alias("member_json"),
        F.lit(1).cast("long").alias("occurrence_count"), "line_start", "line_end", "column_start", "column_end", F.to_json(F.struct(*basis)).alias("extra_json"),
    )
