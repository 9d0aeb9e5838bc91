"""Routing signals over observed identities, the strength of six concepts, and the index over repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import bounded_sample, rule_matches

CONCEPTS = ("data_model", "system_interaction", "data_flow", "persistence", "workflow", "reference_data")
STRENGTHS = ("not_observed", "weak", "moderate", "strong")
SAMPLES = 12

_A, _N, _C, _D = "annotation_observation", "import_namespace_observation", "api_call_observation", "dependency_observation"
_PLAIN = "observed_identity_metadata_match"

# Signal, concepts, kinds, label pattern, facet pattern, mechanism, basis. Patterns ignore case.
SIGNAL_RULES = [
    ("declared_model_annotation", ["data_model"], [_A], r"(?:^|.*)(?:Entity|RootEntity|Embeddable|MappedSuperclass|Document)$", None, None, _PLAIN),
    ("formal_schema_format", ["data_model"], ["source_format_observation"], r"^(?:openapi|json[-_ ]?schema|xsd|proto(?:buf)?|avro)$", None, None, _PLAIN),
    ("model_namespace_naming", ["data_model"], [_N], r"(?:^|\.)(?:model|domain|entity|dto)(?:\.|$)", None, None, "observed_namespace_naming_signal"),
    ("rest_inbound_annotation", ["system_interaction"], [_A], r"^(?:RestController|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)$", None, "rest", _PLAIN),
    ("rest_outbound_client", ["system_interaction"], [_A, _N, _C], r"(?:FeignClient|WebClient|RestTemplate|HttpClient|OkHttpClient|Retrofit)$", r"(?:FeignClient|WebClient|RestTemplate|HttpClient|OkHttpClient|Retrofit)", "rest", _PLAIN),
    ("kafka_consumer", ["system_interaction"], [_A, _N, _C], r"(?:KafkaListener|KafkaConsumer|ConsumerRecord|ConsumerFactory)$", r"(?:KafkaConsumer|ConsumerRecord|ConsumerFactory)", "kafka", _PLAIN),
    ("kafka_producer", ["system_interaction"], [_N, _C], r"(?:KafkaTemplate|KafkaProducer|ProducerRecord|ProducerFactory)$", r"(?:KafkaTemplate|KafkaProducer|ProducerRecord|ProducerFactory)", "kafka", _PLAIN),
    ("jms_messaging", ["system_interaction"], [_A, _N, _C], r"(?:JmsListener|JmsTemplate|MessageListener)$|(?:^|\.)(?:jakarta|javax)\.jms(?:\.|$)", r"(?:JmsTemplate|MessageListener|(?:jakarta|javax)\.jms)", "jms", _PLAIN),
    ("soap_webservice", ["system_interaction"], [_A, _N, _C], r"(?:WebServiceClient|WebServiceTemplate|SoapAction|WebService)$|(?:^|\.)(?:jakarta|javax)\.xml\.ws(?:\.|$)", r"(?:WebServiceClient|WebServiceTemplate|SoapAction|(?:jakarta|javax)\.xml\.ws)", "soap", _PLAIN),
    ("messaging_dependency", ["system_interaction"], [_D], r"(?:kafka|spring-kafka|activemq|artemis|jms|cxf|soap|webservice)", None, None, "observed_dependency_only"),
    ("mapping_annotation", ["data_flow"], [_A], r"^(?:Mapper|Mapping|Mappings|AfterMapping|BeforeMapping)$", None, None, _PLAIN),
    ("mapping_or_conversion_identity", ["data_flow"], [_N, _C], r"(?:Mapper|Converter|Transformer)$|^(?:map|convert|transform|serialize|deserialize)$", r"(?:Mapper|Converter|Transformer)", None, "observed_mapping_or_conversion_naming_signal"),
    ("sql_structure", ["persistence"], ["sql_statement_family"], r".+", None, None, "observed_sql_statement_family"),
    ("persistence_annotation", ["persistence", "data_model"], [_A], r"^(?:Entity|Table|Column|Id|EmbeddedId|Embeddable|MappedSuperclass|Repository|Document)$", None, None, _PLAIN),
    ("persistence_namespace", ["persistence"], [_N], r"^(?:jakarta|javax)\.persistence(?:\.|$)|^org\.jooq(?:\.|$)|^org\.springframework\.(?:jdbc|data)(?:\.|$)|(?:^|\.)mybatis(?:\.|$)", None, None, _PLAIN),
    ("persistence_dependency", ["persistence"], [_D], r"(?:jooq|hibernate|jdbc|spring-data|liquibase|flyway|mybatis|postgres|oracle|mysql|mariadb)", None, None, "observed_dependency_only"),
    ("workflow_orchestration_annotation", ["workflow"], [_A], r"^(?:ServiceActivator|Router|Transformer|Scheduled|EventListener|Saga|StateMachine)$", None, None, _PLAIN),
    ("workflow_orchestration_identity", ["workflow"], [_N, _C], r"(?:IntegrationFlow|ServiceActivator|MessageRouter|StateMachine|ProcessManager|Workflow|Saga)$", r"(?:IntegrationFlow|ServiceActivator|MessageRouter|StateMachine|ProcessManager|Workflow|Saga)", None, _PLAIN),
    ("reference_data_annotation", ["reference_data"], [_A], r"(?:Dictionary|ReferenceData|CodeList|Classifier|Lookup)", None, None, "observed_reference_data_naming_signal"),
    ("reference_data_namespace", ["reference_data"], [_N], r"(?:^|\.)(?:dictionary|dictionaries|reference|referencedata|codelist|lookup)(?:\.|$)|(?:^|\.)nsi(?:\.|$)", None, None, "observed_reference_data_namespace_naming_signal"),
]

#: Per concept: rows of (strength, at least so many of these signals, ...), tried in order. A condition is
#: (least number, signals); all conditions of a row must hold.
_MODEL = ("declared_model_annotation", "formal_schema_format", "persistence_annotation")
_TALK = ("rest_inbound_annotation", "rest_outbound_client", "kafka_consumer", "kafka_producer", "jms_messaging", "soap_webservice")
_STORE = ("sql_structure", "persistence_annotation", "persistence_namespace")
_NAMING = ("model_namespace_naming",)
STRENGTH_RULES = {
    "data_model": [
        ("strong", (2, _MODEL)),
        ("strong", (1, ("declared_model_annotation", "formal_schema_format")), (1, _NAMING)),
        ("moderate", (1, _MODEL)),
        ("weak", (1, _NAMING)),
    ],
    "system_interaction": [("strong", (2, _TALK)), ("moderate", (1, _TALK)), ("weak", (1, ("messaging_dependency",)))],
    "data_flow": [("strong", (2, ("mapping_annotation", "mapping_or_conversion_identity"))), ("moderate", (1, ("mapping_annotation", "mapping_or_conversion_identity")))],
    "persistence": [("strong", (2, _STORE)), ("moderate", (1, _STORE)), ("weak", (1, ("persistence_dependency",)))],
    "workflow": [("strong", (2, ("workflow_orchestration_annotation", "workflow_orchestration_identity"))), ("moderate", (1, ("workflow_orchestration_annotation", "workflow_orchestration_identity")))],
    "reference_data": [("strong", (2, ("reference_data_annotation", "reference_data_namespace"))), ("moderate", (1, ("reference_data_annotation",))), ("weak", (1, ("reference_data_namespace",)))],
}


def rules_table(spark: SparkSession, rules=SIGNAL_RULES) -> DataFrame:
    fold = lambda p: None if p is None else "(?i)" + p
    rows = [(s, c, k, fold(lp), fold(fp), m, b) for s, c, k, lp, fp, m, b in rules]
    return spark.createDataFrame(rows, "signal_id string, concepts array<string>, kinds array<string>, label_pattern string, facet_pattern string, mechanism string, basis string")


def signals(identities: DataFrame, rules: DataFrame | None = None, samples: int = SAMPLES) -> DataFrame:
    """One row per repository and matched signal, with sums over its identities and at most ``samples`` examples.

    ``identities``: repo_id, identity_id, family_kind, family_label, facets array<string>, source_family_count,
    occurrence_count, file_count, representative_evidence_id. File counts add up; they are not distinct files.
    """
    hit = rule_matches(identities, rules if rules is not None else rules_table(identities.sparkSession))
    keys = ["repo_id", "signal_id"]
    shown = F.when(F.col("representative_evidence_id") != "", F.col("representative_evidence_id"))
    evidence = bounded_sample(hit, keys, shown, samples, "representative_evidence_ids")
    ids = bounded_sample(hit, keys, F.col("identity_id"), samples, "observed_identity_ids")
    sums = hit.groupBy(*keys, "concepts", "mechanism", "basis").agg(*[F.sum(c).alias(n) for c, n in (("source_family_count",) * 2, ("occurrence_count",) * 2, ("file_count", "file_count_sum"))])
    out = sums.join(evidence, keys, "left").join(ids, keys, "left")
    n, m = F.coalesce("observed_identity_ids_count", F.lit(0)), F.coalesce("representative_evidence_ids_count", F.lit(0))
    none = F.array().cast("array<string>")
    return out.select(
        *keys, "concepts", "mechanism", "basis", n.alias("observed_identity_count"), "source_family_count", "occurrence_count", "file_count_sum", m.alias("representative_evidence_count"),
        F.coalesce("representative_evidence_ids", none).alias("representative_evidence_ids"), (m > samples).alias("evidence_sample_truncated"),
        F.coalesce("observed_identity_ids", none).alias("observed_identity_ids"), (n > samples).alias("identity_sample_truncated"),
    )


def _strength(concept: str, found: Column) -> Column:
    out = None
    for name, *conditions in STRENGTH_RULES[concept]:
        ok = F.lit(True)
        for least, ids in conditions:
            ok = ok & (F.size(F.array_intersect(found, F.array(*[F.lit(x) for x in ids]))) >= least)
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise("not_observed")


def _rule(concept: str, found: Column) -> Column:
    """Which strength rule decided, in words: how many of which signals."""
    out = None
    for name, *conditions in STRENGTH_RULES[concept]:
        words = name + ": " + " and ".join(f"{least} of {', '.join(ids)}" for least, ids in conditions)
        ok = F.lit(True)
        for least, ids in conditions:
            ok = ok & (F.size(F.array_intersect(found, F.array(*[F.lit(x) for x in ids]))) >= least)
        out = F.when(ok, words) if out is None else out.when(ok, words)
    return out.otherwise("no configured signal was observed")


def basis_rows(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """What each candidate rests on: a row per signal with its mechanism, counts and evidence sample."""
    return candidates.select("repo_id", "concept", F.explode("signals").alias("signal_id")).join(found, ["repo_id", "signal_id"]).drop("concepts")


def concept_signals(concept: str) -> list[str]:
    return sorted({x for _, *conditions in STRENGTH_RULES[concept] for _, ids in conditions for x in ids})


def concept_candidates(repositories: DataFrame, found: DataFrame) -> DataFrame:
    """Six rows per repository: concept, strength, status, the signals it rests on and their mechanisms.

    Which signals are present decides; how often they occur never does. Absence is never claimed as proven.
    """
    per = found.groupBy("repo_id").agg(F.collect_set("signal_id").alias("found"), F.map_from_entries(F.collect_set(F.struct("signal_id", F.coalesce("mechanism", F.lit(""))))).alias("mech"))
    base = repositories.select("repo_id").distinct().join(per, "repo_id", "left")
    have = F.coalesce("found", F.array().cast("array<string>"))
    each = []
    for c in CONCEPTS:
        own = F.array_sort(F.array_intersect(have, F.array(*[F.lit(x) for x in concept_signals(c)])))
        each.append(F.struct(F.lit(c).alias("concept"), _strength(c, have).alias("strength"), own.alias("signals"), _rule(c, have).alias("rule_basis")))
    rows = base.select("repo_id", "mech", F.explode(F.array(*each)).alias("c")).select("repo_id", "mech", "c.*")
    mechs = F.array_sort(F.array_distinct(F.filter(F.transform("signals", lambda s: F.try_element_at(F.col("mech"), s)), lambda m: m.isNotNull() & (m != ""))))
    return rows.select(
        "repo_id", "concept", "strength", F.when(F.col("strength") == "not_observed", "not_observed").otherwise("candidate").alias("status"),
        "signals", mechs.alias("mechanisms"), "rule_basis", F.lit(False).alias("absence_proven"),
    )


def strength_rank(strength: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), strength) - 1


def index_summary(candidates: DataFrame) -> DataFrame:
    """Concept by strength, zeros included."""
    out = candidates.groupBy("concept").pivot("strength", list(STRENGTHS)).count().na.fill(0)
    return out


def concept_index(candidates: DataFrame) -> DataFrame:
    """One row per repository: its six concepts by name, and all mechanisms and signals it was found by."""
    entry = F.struct("concept", F.struct("strength", "signals", "mechanisms").alias("v"))
    g = candidates.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("concepts"))
    every = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values("concepts"), lambda v: v[f]))))
    return g.select("repo_id", "concepts", every("mechanisms").alias("mechanisms"), every("signals").alias("signals"))


def lookup(candidates: DataFrame, concept: str, min_strength: str = "moderate", mechanism: str | None = None) -> DataFrame:
    """Repositories with a concept at a strength or above, strongest first; filters reach a Parquet scan."""
    rows = candidates.filter((F.col("concept") == concept) & F.col("strength").isin(*STRENGTHS[STRENGTHS.index(min_strength) :]))
    if mechanism is not None:
        rows = rows.filter(F.array_contains("mechanisms", mechanism))
    return rows.orderBy(strength_rank(F.col("strength")).desc(), "repo_id")
