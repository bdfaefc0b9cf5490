"""Queries that bind the operators to the given tables, and the same results in SQL, worded another way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import entities, evidence, graph, graphstore, profile, reporting, retrieval, textindex
from corvane.plans import foundation, grounding
from corvane.sources import sinks
from corvane.sources.files import read_text
from corvane.sources.readers import ORDER, Config, normalize_literature, read_csv, read_records, read_yaml
from corvane.staging import new_path, staged

#: The tables' own stand-ins for modalities, status words and rules.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANGUAGES = {"EEG": "en", "fMRI": "de", "DTI": "fr", "MRI": "es"}
RULES = (
    evidence.Rule("tion", "EEG", "slow_wave_density", "slow-wave generation"),
    evidence.Rule("the ", "fMRI", "thalamus_DMN_FC", "thalamocortical coupling"),
    evidence.Rule("mit", "DTI", "FA", "white matter integrity"),
    evidence.Rule("license", "MRI", "thalamus_volume", "thalamic morphology"),
    evidence.Rule("worthless", "Scale", "ISI", "insomnia severity"),
    evidence.Rule("apache", "EEG", "beta_power", "hyperarousal"),
)
MAPPING = (
    ("slow-wave generation", "EEG", ["n_chars", "source"]),
    ("thalamocortical coupling", "fMRI", ["quality", "source"]),
    ("white matter integrity", "DTI", ["toxic", "n_chars", "FA"]),
    ("thalamic morphology", "MRI", ["volume"]),
    ("hyperarousal", "EEG", ["source"]),
)
CONFOUNDS = ("age", "sex", "medication")
LIMITS = profile.Thresholds(0.2, 0.6, 2)
TOP = 20


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Entities: customers are subjects, order priorities modalities, order states quality.


def _orders(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("modality"), F.col("o_orderstatus").alias("qc_status"), F.col("o_orderkey").alias(ORDER))


def _qc(spark, sf_dir) -> DataFrame:
    return entities.qc_records(_orders(spark, sf_dir), ["O"], ["P"], ["F"])


def _subjects(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return entities.normalized(c.select(F.format_string(" %d\t", "c_custkey").alias("sub_id"), F.col("c_mktsegment").alias("group"), F.col("c_nationkey").cast("string").alias("age"), F.lit("").alias("sex"), F.col("c_custkey").alias(ORDER)))


def _covered(spark, sf_dir) -> DataFrame:
    """Which customers each priority's orders hold, as if they were tables of their own."""
    orders = entities.normalized(_orders(spark, sf_dir))
    return entities.coverage({m: orders.filter(F.col("modality") == m) for m in PRIORITIES})


def entity_index(spark, sf_dir) -> DataFrame:
    out = entities.index(_subjects(spark, sf_dir), _covered(spark, sf_dir), entities.overall_status(_qc(spark, sf_dir)), PRIORITIES)
    renamed = {f"has_{m}": f"has_{i}" for i, m in enumerate(PRIORITIES)}
    return out.drop(ORDER).withColumnsRenamed(renamed)


ENTITY_INDEX = """
WITH c AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS h0, bool_or(o_orderpriority = '2-HIGH') AS h1, bool_or(o_orderpriority = '3-MEDIUM') AS h2,
  bool_or(o_orderpriority = '4-NOT SPECIFIED') AS h3, bool_or(o_orderpriority = '5-LOW') AS h4, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS m,
  bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS p, bool_or(o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_mktsegment AS "group", CAST(c_nationkey AS DOUBLE) AS age, '' AS sex,
  coalesce(h0, false) AS has_0, coalesce(h1, false) AS has_1, coalesce(h2, false) AS has_2, coalesce(h3, false) AS has_3, coalesce(h4, false) AS has_4,
  coalesce(m, '') AS available_modalities, CASE WHEN f THEN 'fail' WHEN p THEN 'caution' WHEN o THEN 'pass' ELSE 'unknown' END AS overall_qc_status, '' AS notes
FROM customer LEFT JOIN c ON o_custkey = c_custkey
"""


def qc_status_normalize(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sub"), F.format_string(" %s", F.col("quality").cast("string")).alias("qc_status"), F.col("doc_id").alias(ORDER))
    return entities.qc_records(rows, ["pass", True, "1"], ["caution"], ["fail", False, "0"]).drop(ORDER)


QC_STATUS_NORMALIZE = """
SELECT CAST(doc_id AS VARCHAR) AS subject_id, 'all' AS modality, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'unknown' END AS qc_status,
  CAST(NULL AS VARCHAR) AS qc_metric, CAST(NULL AS VARCHAR) AS qc_value, CAST(NULL AS VARCHAR) AS reason FROM labels
"""


def qc_counts_by_modality(spark, sf_dir) -> DataFrame:
    return entities.qc_counts(_qc(spark, sf_dir))


QC_COUNTS = """
SELECT o_orderpriority AS modality, CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'P' THEN 'caution' WHEN 'F' THEN 'fail' ELSE 'unknown' END AS qc_status, count(*) AS n FROM orders GROUP BY ALL
"""


def worst_status_by_entity(spark, sf_dir) -> DataFrame:
    return entities.overall_status(_qc(spark, sf_dir))


WORST_STATUS = """
SELECT CAST(o_custkey AS VARCHAR) AS subject_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'fail' WHEN bool_or(o_orderstatus = 'P') THEN 'caution'
  WHEN bool_or(o_orderstatus = 'O') THEN 'pass' ELSE 'unknown' END AS overall_qc_status FROM orders GROUP BY o_custkey
"""


def _keyed(df: DataFrame, key: str, **columns) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("subject_id"), *[F.expr(v).cast("string").alias(k) for k, v in columns.items()], F.col(key).cast("bigint").alias(ORDER))


def _merge(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cents = "cast(round({} * 100) as bigint)"
    customers = _keyed(_t(spark, sf_dir, "customer"), "c_custkey", name="c_name", nationkey="c_nationkey", acctbal=cents.format("c_acctbal"))
    suppliers = _keyed(_t(spark, sf_dir, "supplier"), "s_suppkey", name="s_name", nationkey="s_nationkey", acctbal=cents.format("s_acctbal"))
    parts = _keyed(_t(spark, sf_dir, "part"), "p_partkey", name="p_name", brand="p_brand", size="p_size")
    return entities.merged(customers, {"EEG": suppliers, "fMRI": parts}, conflicts="all")


def master_merge(spark, sf_dir) -> DataFrame:
    return _merge(spark, sf_dir)[0].drop(ORDER)


_MERGE = """
WITH c AS (SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nationkey, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS acctbal FROM customer),
s AS (SELECT s_suppkey AS k, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nationkey, CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR) AS acctbal FROM supplier),
p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part),
m AS (SELECT coalesce(c.k, s.k, p.k) AS k, CASE WHEN c.k IS NOT NULL THEN c.name WHEN s.k IS NOT NULL THEN s.name ELSE p.name END AS name,
  CASE WHEN c.k IS NOT NULL THEN c.nationkey ELSE s.nationkey END AS nationkey, CASE WHEN c.k IS NOT NULL THEN c.acctbal ELSE s.acctbal END AS acctbal,
  p.brand, p.size, s.name AS sn, s.nationkey AS sk, s.acctbal AS sa, p.name AS pn FROM c FULL JOIN s ON c.k = s.k FULL JOIN p ON coalesce(c.k, s.k) = p.k)
"""
MASTER_MERGE = _MERGE + """
SELECT CAST(k AS VARCHAR) AS subject_id, coalesce(name, '') AS name, coalesce(nationkey, '') AS nationkey, coalesce(acctbal, '') AS acctbal, coalesce(brand, '') AS brand, coalesce(size, '') AS size,
  CASE WHEN sn <> name AND sn <> '' THEN sn ELSE '' END AS "EEG_name", CASE WHEN sk <> nationkey AND sk <> '' THEN sk ELSE '' END AS "EEG_nationkey",
  CASE WHEN sa <> acctbal AND sa <> '' THEN sa ELSE '' END AS "EEG_acctbal", CASE WHEN pn <> name AND pn <> '' THEN pn ELSE '' END AS "fMRI_name", '' AS "fMRI_brand", '' AS "fMRI_size" FROM m
"""


def master_merge_log(spark, sf_dir) -> DataFrame:
    return _merge(spark, sf_dir)[1]


MASTER_MERGE_LOG = _MERGE + """
SELECT * FROM (SELECT 'name' AS "column", 'EEG_name' AS renamed_to, 'EEG' AS modality, count(*) FILTER (sn <> name AND sn <> '') AS n FROM m
UNION ALL SELECT 'nationkey', 'EEG_nationkey', 'EEG', count(*) FILTER (sk <> nationkey AND sk <> '') FROM m
UNION ALL SELECT 'acctbal', 'EEG_acctbal', 'EEG', count(*) FILTER (sa <> acctbal AND sa <> '') FROM m
UNION ALL SELECT 'name', 'fMRI_name', 'fMRI', count(*) FILTER (pn <> name AND pn <> '') FROM m) WHERE n > 0
"""


def master_merge_found(spark, sf_dir) -> DataFrame:
    """The merge with columns for the conflicts there are; subjects repeat, and their last row counts."""
    o = _t(spark, sf_dir, "orders")
    subjects = o.select(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias(ORDER))
    customers = _keyed(_t(spark, sf_dir, "customer"), "c_custkey", name="c_name", status="c_mktsegment")
    suppliers = _keyed(_t(spark, sf_dir, "supplier"), "s_suppkey", name="s_name", nation="s_nationkey")
    return entities.merged(subjects, {"EEG": customers, "fMRI": suppliers})[0].drop(ORDER)


MASTER_MERGE_FOUND = """
WITH o AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey),
m AS (SELECT coalesce(o.k, c_custkey, s_suppkey) AS k, o.k AS ok, o.status, o.priority, c_custkey AS ck, c_name, c_mktsegment, s_suppkey AS sk, s_name, s_nationkey
  FROM o FULL JOIN customer ON o.k = c_custkey FULL JOIN supplier ON coalesce(o.k, c_custkey) = s_suppkey)
SELECT CAST(k AS VARCHAR) AS subject_id, coalesce(status, c_mktsegment, '') AS status, coalesce(priority, '') AS priority, coalesce(c_name, s_name, '') AS name, coalesce(CAST(s_nationkey AS VARCHAR), '') AS nation,
  CASE WHEN ok IS NOT NULL AND c_mktsegment <> status AND c_mktsegment <> '' THEN c_mktsegment ELSE '' END AS "EEG_status", CASE WHEN ck IS NOT NULL AND s_name <> c_name AND s_name <> '' THEN s_name ELSE '' END AS "fMRI_name" FROM m
"""


# Figures of the reports.


def coverage_counts(spark, sf_dir) -> DataFrame:
    return reporting.coverage_counts(_covered(spark, sf_dir))


COVERAGE_COUNTS = "SELECT o_orderpriority AS modality, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority"


def modality_summary(spark, sf_dir) -> DataFrame:
    """Six modalities, one of them none of the usual: customers' orders by priority, and suppliers under a name of their own."""
    o = _t(spark, sf_dir, "orders")
    tables = {}
    for i, (m, priority) in enumerate(zip(entities.MODALITIES, PRIORITIES), 2):
        price = F.when(F.col("o_orderkey") % i == 0, "NA").otherwise(F.floor("o_totalprice").cast("string"))
        tables[m] = o.filter(F.col("o_orderpriority") == priority).select(F.col("o_custkey").cast("string").alias("subject_id"), price.alias(f"price_{i}"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias(ORDER))
    acct = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.floor("s_acctbal").cast("string"))
    tables["PET"] = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("subject_id"), acct.alias("acct"), F.col("s_name").alias("tracer"), F.col("s_nationkey").cast("string").alias("age"), F.col("s_suppkey").alias(ORDER))
    covered = staged(entities.coverage(tables), "covered")
    features = profile.approved(profile.registry({m: (df, m) for m, df in tables.items()}), profile.Thresholds(0.3, 0.3, 2))
    index = entities.index(_subjects(spark, sf_dir), covered, entities.overall_status(_qc(spark, sf_dir)), list(tables))
    flags = index.agg(*[F.count_if(f"has_{m}").alias(m) for m in tables]).select(F.inline(F.array(*[F.struct(F.lit(m).alias("bucket"), F.col(m).alias("n_flagged")) for m in tables])))
    out = reporting.modality_summary(covered, profile.approved_buckets(features, list(tables))).join(flags, "bucket", "left")
    return out.select("bucket", "n_subjects", F.coalesce("n_flagged", F.lit(0)).cast("bigint").alias("n_flagged"), "n_approved", F.concat_ws(",", "names").alias("names"))


MODALITY_SUMMARY = """
WITH t AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'EEG' WHEN '2-HIGH' THEN 'fMRI' WHEN '3-MEDIUM' THEN 'DTI' WHEN '4-NOT SPECIFIED' THEN 'MRI' WHEN '5-LOW' THEN 'scales' END AS m, o_custkey AS k, o_orderkey AS o,
  CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 5 ELSE 6 END AS i FROM orders),
c AS (SELECT m, 'price_' || i AS feature, o % i <> 0 AS there FROM t UNION ALL SELECT m, 'status', true FROM t UNION ALL SELECT 'PET', 'acct', s_suppkey % 3 <> 0 FROM supplier UNION ALL SELECT 'PET', 'tracer', true FROM supplier),
a AS (SELECT m, feature FROM c GROUP BY ALL HAVING count(*) FILTER (there) >= 2 AND round(1.0 - count(*) FILTER (there) / count(*), 3) <= 0.3
  UNION ALL SELECT 'covariates', 'age' FROM supplier HAVING count(*) >= 2),
s AS (SELECT m, k FROM t UNION SELECT 'PET', s_suppkey FROM supplier),
n AS (SELECT m, count(*) AS n_subjects, count(c_custkey) AS n_flagged FROM s LEFT JOIN customer ON c_custkey = k GROUP BY m)
SELECT bucket, coalesce(any_value(n_subjects), 0) AS n_subjects, coalesce(any_value(n_flagged), 0) AS n_flagged, count(feature) AS n_approved, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS names
FROM (SELECT unnest(['EEG', 'fMRI', 'DTI', 'MRI', 'scales', 'PET', 'covariates', 'group', 'qc']) AS bucket) LEFT JOIN a ON a.m = bucket LEFT JOIN n ON n.m = bucket GROUP BY bucket
"""


def qc_histogram(spark, sf_dir) -> DataFrame:
    return reporting.qc_histogram(_qc(spark, sf_dir)).drop(ORDER)


QC_HISTOGRAM = """
SELECT qc_status, count(o_orderkey) AS n FROM (VALUES ('pass', 'O'), ('caution', 'P'), ('fail', 'F'), ('unknown', '')) AS s(qc_status, word)
LEFT JOIN orders ON CASE WHEN o_orderstatus IN ('O', 'P', 'F') THEN o_orderstatus ELSE '' END = word GROUP BY qc_status
"""


def group_sizes(spark, sf_dir) -> DataFrame:
    return reporting.group_sizes(_subjects(spark, sf_dir))


GROUP_SIZES = "SELECT c_mktsegment AS \"group\", count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY c_mktsegment"


def _measured(spark, sf_dir) -> DataFrame:
    """Orders as subjects with a column of every role."""
    o = _t(spark, sf_dir, "orders")
    some = lambda k, v: f"CASE WHEN o_orderkey % {k} = 0 THEN '' ELSE CAST({v} AS string) END"
    return _keyed(
        o, "o_orderkey", group=some(4, "o_orderstatus"), age=some(3, "o_custkey"), ISI=some(2, "o_custkey % 28"), PSQI="o_orderpriority", anxiety_score="'NA'", QC_flag="o_orderstatus", latency=some(7, "o_custkey")
    )


def _roles(spark, sf_dir) -> DataFrame:
    rows = staged(_measured(spark, sf_dir), "measured")
    return profile.approved(profile.registry({"scales": (rows, "orders")}), profile.Thresholds(0.3, 0.6, 2))


def role_approval(spark, sf_dir) -> DataFrame:
    return _roles(spark, sf_dir).select("feature_name", "role", "dtype", "missing_rate", "n_available", "approved", "approval_reason")


_ROLES = """
WITH o AS (SELECT *, o_orderkey AS k FROM orders),
c AS (SELECT CASE WHEN k % 4 = 0 THEN '' ELSE o_orderstatus END AS "group", CASE WHEN k % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS age, CASE WHEN k % 2 = 0 THEN '' ELSE CAST(o_custkey % 28 AS VARCHAR) END AS "ISI",
  o_orderpriority AS "PSQI", 'NA' AS anxiety_score, o_orderstatus AS "QC_flag", CASE WHEN k % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS latency FROM o),
u AS (UNPIVOT c ON * INTO NAME feature_name VALUE v),
s AS (SELECT feature_name, count(*) AS total, count(*) FILTER (v NOT IN ('', 'NA')) AS n_available, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (v NOT IN ('', 'NA')) AS num FROM u GROUP BY feature_name),
r AS (SELECT feature_name, CASE feature_name WHEN 'group' THEN 'group' WHEN 'age' THEN 'covariate' WHEN 'ISI' THEN 'outcome' WHEN 'PSQI' THEN 'outcome' WHEN 'anxiety_score' THEN 'scale' WHEN 'QC_flag' THEN 'qc' ELSE 'feature' END AS role,
  CASE WHEN n_available = 0 THEN 'unknown' WHEN num THEN 'numeric' ELSE 'categorical' END AS dtype, round(1.0 - n_available / total, 3) AS missing_rate, n_available FROM s),
a AS (SELECT *, CASE WHEN missing_rate > CASE WHEN role IN ('outcome', 'group') THEN 0.3 ELSE 0.6 END THEN 'missing_rate>' || CASE WHEN role IN ('outcome', 'group') THEN '0.3' ELSE '0.6' END
  WHEN n_available < 2 THEN 'n_available<2' ELSE 'passes missingness and sample-size thresholds' END AS approval_reason FROM r)
"""
ROLE_APPROVAL = _ROLES + "SELECT *, approval_reason LIKE 'passes%' AS approved FROM a"


def approved_totals(spark, sf_dir) -> DataFrame:
    return reporting.approved_totals(profile.approved_buckets(_roles(spark, sf_dir))).drop(ORDER)


APPROVED_TOTALS = _ROLES + """
SELECT bucket, count(feature_name) AS n FROM (SELECT unnest(['EEG', 'fMRI', 'DTI', 'MRI', 'scales', 'covariates', 'group', 'qc']) AS bucket)
LEFT JOIN (SELECT * FROM a WHERE approval_reason LIKE 'passes%') ON bucket = CASE role WHEN 'covariate' THEN 'covariates' WHEN 'group' THEN 'group' WHEN 'qc' THEN 'qc' ELSE 'scales' END GROUP BY bucket
"""


def foundation_warnings(spark, sf_dir) -> DataFrame:
    subjects = _subjects(spark, sf_dir).drop("age", "sex")
    return reporting.warnings(_roles(spark, sf_dir), subjects, _qc(spark, sf_dir), 300, 0.35).select("warning")


FOUNDATION_WARNINGS = _ROLES + """
SELECT 'High missingness: ' || feature_name || ' (' || missing_rate || ')' AS warning FROM r WHERE missing_rate > 0.35
UNION ALL SELECT 'Small group size: ' || c_mktsegment || ' n=' || count(*) FROM customer GROUP BY c_mktsegment HAVING count(*) < 300
UNION ALL SELECT 'QC failures present: ' || count(*) || ' records' FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0
UNION ALL SELECT 'Missing key covariate: sex'
"""


# Profiles: documents by language with their labels, all as text.


def _labelled(spark, sf_dir) -> DataFrame:
    d, label = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    each = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("n_chars", "source", "quality", "toxic")]
    return d.join(label, "doc_id", "left").select("lang", F.col("doc_id").cast("string").alias("subject_id"), *each, F.col("doc_id").alias(ORDER))


def _registry(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    rows = rows or staged(_labelled(spark, sf_dir), "labelled")
    return profile.registry({m: (rows.filter(F.col("lang") == lang).drop("lang"), f"documents/{lang}") for m, lang in LANGUAGES.items()})


def column_profile(spark, sf_dir) -> DataFrame:
    return _registry(spark, sf_dir).drop(ORDER).withColumn("qc_dependency", F.concat_ws(",", "qc_dependency"))


_REGISTRY = """
WITH b AS (SELECT CASE lang WHEN 'en' THEN 'EEG' WHEN 'de' THEN 'fMRI' WHEN 'fr' THEN 'DTI' ELSE 'MRI' END AS modality, lang, coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars,
  coalesce(source, '') AS source, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'de', 'fr', 'es')),
u AS (UNPIVOT b ON n_chars, source, quality, toxic INTO NAME feature_name VALUE v),
s AS (SELECT modality, lang, feature_name, count(*) AS total, count(*) FILTER (trim(v) NOT IN ('', 'NA', 'N/A', 'nan', 'None', 'null')) AS available,
  bool_and(try_cast(v AS DOUBLE) IS NOT NULL) FILTER (trim(v) NOT IN ('', 'NA', 'N/A', 'nan', 'None', 'null')) AS num FROM u GROUP BY ALL),
r AS (SELECT feature_name, modality, 'documents/' || lang AS source_file, feature_name AS source_column, 'feature' AS role,
  CASE WHEN available = 0 THEN 'unknown' WHEN num THEN 'numeric' ELSE 'categorical' END AS dtype, '' AS unit, modality || ' variable ' || feature_name AS description,
  round(1.0 - available / total, 3) AS missing_rate, available AS n_available, modality AS qc_dependency,
  CASE modality WHEN 'EEG' THEN 0 WHEN 'fMRI' THEN 1 WHEN 'DTI' THEN 2 ELSE 3 END * 10 + CASE feature_name WHEN 'n_chars' THEN 0 WHEN 'source' THEN 1 WHEN 'quality' THEN 2 ELSE 3 END AS o FROM s),
a AS (SELECT *, CASE WHEN missing_rate > 0.6 THEN 'missing_rate>0.6' WHEN n_available < 2 THEN 'n_available<2' ELSE 'passes missingness and sample-size thresholds' END AS approval_reason FROM r)
"""
COLUMN_PROFILE = _REGISTRY + "SELECT * EXCLUDE (o), false AS approved, 'pending approval' AS approval_reason FROM r"


def feature_approval(spark, sf_dir) -> DataFrame:
    return profile.approved(_registry(spark, sf_dir), LIMITS).select("modality", "feature_name", "missing_rate", "n_available", "approved", "approval_reason")


FEATURE_APPROVAL = _REGISTRY + "SELECT modality, feature_name, missing_rate, n_available, approval_reason LIKE 'passes%' AS approved, approval_reason FROM a"


def approved_buckets(spark, sf_dir) -> DataFrame:
    return profile.approved_buckets(profile.approved(_registry(spark, sf_dir), LIMITS)).select("bucket", F.concat_ws(",", "names").alias("names"))


APPROVED_BUCKETS = _REGISTRY + """
SELECT bucket, coalesce(string_agg(feature_name, ',' ORDER BY feature_name), '') AS names FROM (SELECT unnest(['EEG', 'fMRI', 'DTI', 'MRI', 'scales', 'covariates', 'group', 'qc']) AS bucket)
LEFT JOIN (SELECT * FROM a WHERE approval_reason LIKE 'passes%') ON modality = bucket GROUP BY bucket
"""


def data_dictionary(spark, sf_dir) -> DataFrame:
    return profile.dictionary(_registry(spark, sf_dir)).drop(ORDER, "valid_range").withColumn("allowed_values", F.concat_ws(",", "allowed_values"))


DATA_DICTIONARY = _REGISTRY + "SELECT feature_name AS variable, modality, role, description, unit, source_file, source_column, '' AS allowed_values FROM r"


def feature_counts(spark, sf_dir) -> DataFrame:
    return reporting.feature_counts(_registry(spark, sf_dir))


FEATURE_COUNTS = _REGISTRY + "SELECT modality, count(*) AS n FROM r GROUP BY modality"


def missing_topk(spark, sf_dir) -> DataFrame:
    return profile.most_missing(_registry(spark, sf_dir), 6).select("modality", "feature_name", "missing_rate")


MISSING_TOPK = _REGISTRY + "SELECT modality, feature_name, missing_rate FROM r ORDER BY missing_rate DESC, o LIMIT 6"


def _observed(spark, sf_dir) -> DataFrame:
    rows = staged(_labelled(spark, sf_dir), "labelled")
    return profile.observed_profile(profile.approved(_registry(spark, sf_dir, rows), LIMITS), rows, ["quality"])


def observed_profile(spark, sf_dir) -> DataFrame:
    return _observed(spark, sf_dir).drop(ORDER)


_OBSERVED = _REGISTRY + """
, w AS (SELECT feature_name, round(1.0 - count(*) FILTER (trim(v) NOT IN ('', 'NA', 'nan', 'None')) / count(*), 3) AS mr, count(*) FILTER (trim(v) NOT IN ('', 'NA', 'nan', 'None')) AS na FROM u GROUP BY feature_name),
ob AS (SELECT feature_name, modality, source_file, source_column, mr AS missing_rate, na AS n_available, 'pass' AS qc_status, approval_reason LIKE 'passes%' OR feature_name = 'quality' AS approved, role, o FROM a JOIN w USING (feature_name))
"""
OBSERVED_PROFILE = _OBSERVED + "SELECT * EXCLUDE (o) FROM ob"


def _ready(spark, sf_dir) -> DataFrame:
    return profile.analysis_ready(_observed(spark, sf_dir), profile.ReadyRules(0.62, 2))


def analysis_ready(spark, sf_dir) -> DataFrame:
    return _ready(spark, sf_dir).drop(ORDER)


ANALYSIS_READY = _OBSERVED + "SELECT * EXCLUDE (o) FROM ob WHERE approved AND missing_rate <= 0.62 AND n_available >= 2"


# The plans, from files to files: tables are written as sources, the plan is built and written, and its outputs are read.


def _lines(df: DataFrame, artifact: str) -> DataFrame:
    """(artifact, line): a table's rows as text, cells by name."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in sorted(df.columns) if c != ORDER]
    return df.select(F.lit(artifact).alias("artifact"), F.concat_ws("|", *cells).alias("line"))


def foundation_outputs(spark, sf_dir) -> DataFrame:
    """All outputs of the foundation plan over customers (subjects), suppliers and parts (modalities) and orders (quality)."""
    at = new_path(spark, "foundation-plan")
    customers = _t(spark, sf_dir, "customer").select(F.format_string(" %d", "c_custkey").alias("sub_id"), F.col("c_mktsegment").alias("group"), F.col("c_nationkey").alias("age"), F.col("c_custkey").alias(ORDER))
    some = F.when(F.col("s_suppkey") % 3 == 0, "NA").otherwise(F.floor("s_acctbal").cast("string"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.col("s_name").alias("label"), some.alias("power"), F.col("s_suppkey").alias(ORDER))
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject_id"), F.col("p_name").alias("label"), F.col("p_size").alias("ISI"), F.col("p_brand").alias("medication"), F.col("p_partkey").alias(ORDER))
    for name, df in (("subjects", customers), ("eeg", suppliers), ("scales", parts), ("qc", _orders(spark, sf_dir))):
        sinks.write_csv(df, f"{at}/in/{name}")
    tables = ("subject_index", "qc_summary", "feature_registry", "multimodal_master_table")
    config = Config(
        {
            "inputs": {"subject_table": "in/subjects", "eeg_features": "in/eeg", "fmri_features": "in/none", "scale_features": "in/scales", "qc_summary": "in/qc"},
            "outputs": {k: f"out/{k}" for k in (*tables, "approved_variables", "data_dictionary", "report")},
            "subject_id": {"column": "subject_id", "aliases": ["sub_id"]},
            "qc": {"pass_values": ["O"], "caution_values": ["P"], "fail_values": ["F"]},
            "thresholds": {"max_missing_rate_primary": 0.2, "max_missing_rate_secondary": 0.2, "min_n_total": 2, "min_n_per_group": 1},
        },
        at,
    )
    done = foundation.write(foundation.build(spark, config))
    out = reduce(DataFrame.unionByName, [_lines(read_csv(spark, f"{at}/out/{t}", order="none").drop("source_file"), t) for t in tables])
    lists, words = read_yaml(f"{at}/out/approved_variables", spark), read_yaml(f"{at}/out/data_dictionary", spark)["variables"]
    told = [("approved_variables", f"{k}={','.join(v)}") for k, v in lists.items()]
    told += [("data_dictionary", f"{v['variable']}={v['modality']},{v['role']},{v['description']}") for v in words]
    told += [("figures", f"{k}={done[k]}") for k in ("subject_count", "feature_count", "qc_record_count", "master_rows", "master_columns")]
    told += [("coverage", f"{k}={n}") for k, n in done["merge_log"]["modality_subject_coverage"].items()]
    told += [("conflicts", f"{c['renamed_to']}={c['n']}") for c in done["merge_log"]["duplicate_columns"]]
    keep = ("- Total subjects", "- Rows", "- Columns", "- Input files", "- Total approved", "- pass", "- caution", "- fail", "- unknown", "- High missingness", "- QC failures", "- Missing key")
    told += [("report", x) for x in read_text(f"{at}/out/report", spark).splitlines() if x.startswith(keep)]
    return out.unionByName(spark.createDataFrame(told, "artifact string, line string"))


FOUNDATION_OUTPUTS = """
WITH q AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS p, bool_or(o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey),
i AS (SELECT c_custkey AS k, c_mktsegment AS g, CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) AS age, s_suppkey IS NOT NULL AS eeg, p_partkey IS NOT NULL AS sc, CASE WHEN f THEN 'fail' WHEN p THEN 'caution' WHEN o THEN 'pass' ELSE 'unknown' END AS st
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN q ON q.k = c_custkey),
j AS (SELECT *, 'age=' || age AS a, concat_ws(';', CASE WHEN eeg THEN 'EEG' END, CASE WHEN sc THEN 'scales' END) AS av FROM i),
e AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'NA' ELSE CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) END AS power FROM supplier),
m AS (SELECT coalesce(j.k, e.k, p_partkey) AS k, j.k IS NOT NULL AS there, g, age, eeg, sc, st, av, s_name, power, p_name, p_size, p_brand FROM j FULL JOIN e ON j.k = e.k FULL JOIN part ON coalesce(j.k, e.k) = p_partkey),
r AS (SELECT 'label' AS f, 'EEG' AS mo, 'feature' AS ro, 'categorical' AS dt, count(*) AS n, count(*) AS t FROM supplier
  UNION ALL SELECT 'power', 'EEG', 'feature', 'numeric', count(*) FILTER (s_suppkey % 3 <> 0), count(*) FROM supplier UNION ALL SELECT 'label', 'scales', 'feature', 'categorical', count(*), count(*) FROM part
  UNION ALL SELECT 'ISI', 'scales', 'outcome', 'numeric', count(*), count(*) FROM part UNION ALL SELECT 'medication', 'scales', 'covariate', 'categorical', count(*), count(*) FROM part),
a AS (SELECT *, round(1.0 - n / t, 3) AS mr FROM r), ap AS (SELECT *, mr <= 0.2 AS ok FROM a),
b AS (SELECT unnest(['EEG', 'fMRI', 'DTI', 'MRI', 'scales', 'covariates', 'group', 'qc']) AS bucket)
SELECT 'subject_index' AS artifact, a || '|available_modalities=' || av || '|group=' || g || '|has_DTI=false|has_EEG=' || eeg || '|has_MRI=false|has_fMRI=false|has_scales=' || sc || '|notes=|overall_qc_status=' || st || '|sex=|subject_id=' || k AS line FROM j
UNION ALL SELECT 'qc_summary', 'modality=' || o_orderpriority || '|qc_metric=|qc_status=' || CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'P' THEN 'caution' WHEN 'F' THEN 'fail' ELSE 'unknown' END || '|qc_value=|reason=|subject_id=' || o_custkey FROM orders
UNION ALL SELECT 'feature_registry', 'approval_reason=' || CASE WHEN ok THEN 'passes missingness and sample-size thresholds' ELSE 'missing_rate>0.2' END || '|approved=' || ok || '|description=' || mo || ' variable ' || f || '|dtype=' || dt || '|feature_name=' || f
  || '|missing_rate=' || mr || '|modality=' || mo || '|n_available=' || n || '|qc_dependency=["' || mo || '"]|role=' || ro || '|source_column=' || f || '|unit=' FROM ap
UNION ALL SELECT 'multimodal_master_table', 'ISI=' || coalesce(CAST(p_size AS VARCHAR), '') || '|age=' || coalesce(age, '') || '|available_modalities=' || coalesce(av, '') || '|group=' || coalesce(g, '') || '|has_DTI=' || CASE WHEN there THEN 'false' ELSE '' END
  || '|has_EEG=' || coalesce(CAST(eeg AS VARCHAR), '') || '|has_MRI=' || CASE WHEN there THEN 'false' ELSE '' END || '|has_fMRI=' || CASE WHEN there THEN 'false' ELSE '' END || '|has_scales=' || coalesce(CAST(sc AS VARCHAR), '') || '|label=' || coalesce(s_name, p_name)
  || '|medication=' || coalesce(p_brand, '') || '|notes=|overall_qc_status=' || coalesce(st, '') || '|power=' || coalesce(power, '') || '|scales_label=' || CASE WHEN s_name <> p_name THEN p_name ELSE '' END || '|sex=|subject_id=' || k FROM m
UNION ALL SELECT 'approved_variables', bucket || '=' || coalesce(string_agg(f, ',' ORDER BY f), '') FROM b LEFT JOIN ap ON ok AND bucket = CASE ro WHEN 'covariate' THEN 'covariates' ELSE mo END GROUP BY bucket
UNION ALL SELECT 'data_dictionary', f || '=' || mo || ',' || ro || ',' || mo || ' variable ' || f FROM r
UNION ALL SELECT 'figures', 'subject_count=' || count(*) FROM customer UNION ALL SELECT 'figures', 'feature_count=5' UNION ALL SELECT 'figures', 'qc_record_count=' || count(*) FROM orders
UNION ALL SELECT 'figures', 'master_rows=' || count(*) FROM m UNION ALL SELECT 'figures', 'master_columns=17'
UNION ALL SELECT 'coverage', 'EEG=' || count(*) FROM supplier UNION ALL SELECT 'coverage', 'scales=' || count(*) FROM part UNION ALL SELECT 'coverage', unnest(['fMRI=0', 'DTI=0', 'MRI=0'])
UNION ALL SELECT 'conflicts', 'scales_label=' || count(*) FROM m WHERE s_name <> p_name HAVING count(*) > 0
UNION ALL SELECT 'report', '- Total subjects: ' || count(*) FROM customer UNION ALL SELECT 'report', '- Rows: ' || count(*) FROM m UNION ALL SELECT 'report', unnest(['- Columns: 17', '- Input files: 2'])
UNION ALL SELECT 'report', '- Total approved variables: ' || count(DISTINCT (mo, ro = 'covariate', f)) FROM ap WHERE ok
UNION ALL SELECT 'report', '- ' || s || ': ' || (SELECT count(*) FROM orders WHERE CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'P' THEN 'caution' WHEN 'F' THEN 'fail' ELSE 'unknown' END = s) FROM (SELECT unnest(['pass', 'caution', 'fail', 'unknown']) AS s)
UNION ALL SELECT 'report', '- QC failures present: ' || count(*) || ' records' FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0
UNION ALL SELECT 'report', '- High missingness: ' || f || ' (' || mr || ')' FROM ap WHERE mr > 0.35
"""


def data_dictionary_roles(spark, sf_dir) -> DataFrame:
    """A dictionary with the values that a group may have."""
    return profile.dictionary(_roles(spark, sf_dir)).select("variable", "role", F.concat_ws(",", "allowed_values").alias("allowed_values"))


DATA_DICTIONARY_ROLES = _ROLES + "SELECT feature_name AS variable, role, CASE WHEN feature_name = 'group' THEN 'HC,INS' ELSE '' END AS allowed_values FROM r"


# Tables written and read again: the order that they were written in stays.


def _round_trip(df: DataFrame, suffix: str) -> DataFrame:
    at = f"{new_path(df.sparkSession, 'round-trip')}/table.{suffix}"
    if suffix == "csv":
        sinks.write_csv(df, at)
        return read_csv(df.sparkSession, at)
    sinks.write_json(df, at)
    return read_records(df.sparkSession, at)


def csv_round_trip(spark, sf_dir) -> DataFrame:
    """Orders by price, written in that order as parts, and where each row stands when they are read."""
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit('a "b", '), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_custkey").alias("custkey"), F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey").alias(ORDER))
    return _round_trip(o, "csv").select("name", "custkey", F.col(ORDER).alias("position"))


CSV_ROUND_TRIP = """
SELECT 'a "b", ' || o_orderkey AS name, CAST(o_custkey AS VARCHAR) AS custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders
"""


def json_round_trip(spark, sf_dir) -> DataFrame:
    """Customers with a list, by balance, written as JSON Lines and read as records."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("paper_id"), F.array("c_mktsegment", F.lit(" x ")).alias("keywords"), F.struct("c_acctbal", "c_custkey").alias(ORDER))
    rows = normalize_literature(_round_trip(c, "json"))
    return rows.select("paper_id", F.concat_ws(",", "keywords").alias("keywords"), F.col(ORDER).alias("position"))


JSON_ROUND_TRIP = """
SELECT c_name AS paper_id, c_mktsegment || ',x' AS keywords, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer
"""


# Literature: every document is a paper.


def _papers(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select(F.format_string("doc%d", "doc_id").alias("paper_id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("abstract"), F.array("lang", "source").alias("keywords"), F.lit("").alias("notes"), "source", F.col("doc_id").alias(ORDER))


_PAPERS = """
WITH papers AS (SELECT doc_id AS o, 'doc' || doc_id AS paper_id, lang || ' ' || source AS title, lang || ' ' || source || ' ' || text || ' ' || lang || ' ' || source || ' ' AS body, source FROM documents)
"""


def literature_normalize(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    kind, year = F.col("doc_id") % 5, (2000 + F.col("doc_id") % 25).cast("string")
    year = F.when(kind == 0, "2022.0").when(kind == 1, "").when(kind == 2, "0").when(kind == 3, F.concat(F.lit("0"), year)).otherwise(year)
    raw = d.select(
        F.when(F.col("doc_id") % 2 == 0, F.format_string(" p%d ", "doc_id")).otherwise("").alias("paper_id"),
        F.concat(F.lit("\t"), "source", F.lit(" ")).alias("title"),
        F.col("text").alias("abstract"),
        year.alias("year"),
        F.concat("lang", F.lit("; "), "source", F.lit(" | ,")).alias("keywords"),
        F.col("doc_id").alias(ORDER),
    )
    out = normalize_literature(raw).withColumns({"keywords": F.array_join("keywords", "/"), "year": F.col("year").cast("string")})
    return out.select("paper_id", "title", "abstract", "year", "keywords", "source")


LITERATURE_NORMALIZE = r"""
WITH r AS (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS a, CASE doc_id % 5 WHEN 2 THEN 0 WHEN 3 THEN 2000 + doc_id % 25 WHEN 4 THEN 2000 + doc_id % 25 END AS y FROM documents)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id ELSE 'paper_' || substr(sha1(source || '||' || a || '||' || CASE WHEN y > 0 THEN CAST(y AS VARCHAR) ELSE '' END), 1, 12) END AS paper_id, source AS title, a AS abstract,
  CAST(y AS VARCHAR) AS year, lang || '/' || source AS keywords, '' AS source FROM r
"""


def _evidence(spark, sf_dir) -> DataFrame:
    return evidence.graded(evidence.extracted(_papers(spark, sf_dir), RULES, "cohort"))


def evidence_extract(spark, sf_dir) -> DataFrame:
    return evidence.extracted(_papers(spark, sf_dir), RULES, "cohort").drop(ORDER)


def evidence_grade(spark, sf_dir) -> DataFrame:
    return _evidence(spark, sf_dir).drop(ORDER)


_EVIDENCE = _PAPERS + r"""
, rules(i, k, modality, variable_or_feature, mechanism) AS (VALUES (0, 'tion', 'EEG', 'slow_wave_density', 'slow-wave generation'), (1, 'the ', 'fMRI', 'thalamus_DMN_FC', 'thalamocortical coupling'),
  (2, 'mit', 'DTI', 'FA', 'white matter integrity'), (3, 'license', 'MRI', 'thalamus_volume', 'thalamic morphology'), (4, 'worthless', 'Scale', 'ISI', 'insomnia severity'), (5, 'apache', 'EEG', 'beta_power', 'hyperarousal')),
l AS (SELECT *, lower(body) AS low FROM papers),
ev AS (SELECT o, i, 'evidence_' || substr(sha1(paper_id || '||' || mechanism || '||' || variable_or_feature), 1, 12) AS evidence_id, paper_id, title || ': ' || mechanism || ' related to ' || variable_or_feature AS claim,
  CASE WHEN regexp_matches(low, 'insomnia') THEN 'insomnia' WHEN regexp_matches(low, 'sleep disorder') THEN 'sleep disorder' WHEN regexp_matches(low, 'adults') THEN 'adults' ELSE 'cohort' END AS population,
  modality, variable_or_feature, mechanism,
  CASE WHEN regexp_matches(low, 'no association|not associated|null finding') THEN 'null' WHEN regexp_matches(low, 'refute|opposite|lower than expected') THEN 'refute'
    WHEN regexp_matches(low, 'associated|support|suggest|show|reports|reduced|increased|altered|disrupted') THEN 'support' ELSE 'unclear' END AS direction,
  CASE WHEN regexp_matches(low, 'meta-analysis|meta analysis') THEN 'meta_analysis' WHEN regexp_matches(low, 'review') THEN 'review' WHEN regexp_matches(low, 'case') THEN 'case' WHEN regexp_matches(low, 'method') THEN 'method'
    WHEN regexp_matches(low, 'empirical|study|findings') THEN 'empirical' ELSE 'unknown' END AS evidence_type,
  CASE WHEN strpos(low, 'limitation:') > 0 THEN regexp_replace(substr(body, strpos(low, 'limitation:') + 11), '^\s+|\s+$', '', 'g') WHEN regexp_matches(low, 'small sample') THEN 'small sample'
    WHEN regexp_matches(low, 'cross-sectional') THEN 'cross-sectional' ELSE '' END AS limitation, CAST(0.7 AS DOUBLE) AS confidence_score
  FROM l JOIN rules ON strpos(' ' || low || ' ', k) > 0),
g AS (SELECT *, round(greatest(0, least(1, CASE evidence_type WHEN 'meta_analysis' THEN 90 WHEN 'review' THEN 75 WHEN 'empirical' THEN 80 WHEN 'method' THEN 60 WHEN 'case' THEN 35 ELSE 25 END / 100.0
  + 0.03 + 0.08 + CASE WHEN direction <> 'unclear' THEN 0.04 ELSE -0.04 END + CASE WHEN limitation <> '' THEN 0.03 ELSE 0 END)), 3)::DOUBLE AS evidence_quality_score FROM ev)
"""
EVIDENCE_EXTRACT = _EVIDENCE + "SELECT * EXCLUDE (o, i) FROM ev"
EVIDENCE_GRADE = _EVIDENCE + "SELECT * EXCLUDE (o, i) FROM g"


def evidence_rule_table(spark, sf_dir) -> DataFrame:
    """Rules as a table: the first characters of every benchmark item are a keyword, and so are parts' names."""
    items = _t(spark, sf_dir, "benchmark").select(F.lower(F.substring("text", 1, 24)).alias("keyword"), F.lit("benchmark").alias("modality"), F.format_string("item_%d", "item_id").alias("variable"), F.col("item_id").alias(ORDER))
    parts = _t(spark, sf_dir, "part").select(F.lower("p_name").alias("keyword"), F.col("p_brand").alias("modality"), F.col("p_type").alias("variable"), (F.col("p_partkey") + (1 << 40)).alias(ORDER))
    rules = items.unionByName(parts).withColumn("mechanism", F.upper(F.substring("keyword", 1, 3)))
    return evidence.extracted(_papers(spark, sf_dir), rules).select("evidence_id", "paper_id", "claim", "modality", "variable_or_feature", "mechanism", "direction")


EVIDENCE_RULE_TABLE = _PAPERS + r"""
, rules AS (SELECT k, modality, v, upper(substring(k, 1, 3)) AS mechanism FROM (SELECT lower(substring(text, 1, 24)) AS k, 'benchmark' AS modality, 'item_' || item_id AS v FROM benchmark UNION ALL SELECT lower(p_name), p_brand, p_type FROM part)),
l AS (SELECT *, lower(body) AS low FROM papers)
SELECT 'evidence_' || substr(sha1(paper_id || '||' || mechanism || '||' || v), 1, 12) AS evidence_id, paper_id, title || ': ' || mechanism || ' related to ' || v AS claim, modality, v AS variable_or_feature, mechanism,
  CASE WHEN regexp_matches(low, 'no association|not associated|null finding') THEN 'null' WHEN regexp_matches(low, 'refute|opposite|lower than expected') THEN 'refute'
    WHEN regexp_matches(low, 'associated|support|suggest|show|reports|reduced|increased|altered|disrupted') THEN 'support' ELSE 'unclear' END AS direction
FROM l JOIN rules ON strpos(' ' || low || ' ', k) > 0
"""


def evidence_direction_counts(spark, sf_dir) -> DataFrame:
    return evidence.direction_counts(_evidence(spark, sf_dir)).drop(ORDER)


EVIDENCE_DIRECTION_COUNTS = _EVIDENCE + "SELECT direction, (SELECT count(*) FROM g WHERE g.direction = d.direction) AS n FROM (SELECT unnest(['support', 'refute', 'null', 'unclear']) AS direction) AS d"


def evidence_quality_summary(spark, sf_dir) -> DataFrame:
    return evidence.quality_summary(_evidence(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


EVIDENCE_QUALITY_SUMMARY = _EVIDENCE + "SELECT count(*) AS n, min(evidence_quality_score) AS lowest, round(avg(evidence_quality_score), 6) AS mean, max(evidence_quality_score) AS highest FROM g"


def theoretical_profile(spark, sf_dir) -> DataFrame:
    return profile.theoretical_profile(_evidence(spark, sf_dir)).drop(ORDER)


THEORETICAL_PROFILE = _EVIDENCE + """
SELECT variable_or_feature AS feature_name, arg_min(modality, o * 10 + i) AS modality, 'literature_grounding' AS source_file, variable_or_feature AS source_column, CAST(NULL AS DOUBLE) AS missing_rate,
  CAST(NULL AS BIGINT) AS n_available, '' AS qc_status, false AS approved, 'feature' AS role FROM g GROUP BY variable_or_feature
"""


def _queries(spark, sf_dir) -> DataFrame:
    """The stated query set: every item whose id is divisible by 20."""
    return _t(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword_retrieval(spark, sf_dir) -> DataFrame:
    return retrieval.keyword_retrieve(_papers(spark, sf_dir), _queries(spark, sf_dir), TOP).drop(ORDER)


_RETRIEVAL = _PAPERS + r"""
, q AS (SELECT DISTINCT query_id, lower(t) AS token FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_\-]+')) AS t FROM benchmark WHERE item_id % 20 = 0)),
d AS (SELECT o, lower(t) AS token FROM (SELECT o, unnest(regexp_extract_all(body, '[A-Za-z0-9_\-]+')) AS t FROM papers)),
h AS (SELECT query_id, o, CAST(count(*) AS DOUBLE) AS score FROM d JOIN q USING (token) GROUP BY query_id, o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) <= 20)
"""
KEYWORD_RETRIEVAL = _RETRIEVAL + "SELECT query_id, paper_id, score, substring(body, 1, 300) AS matched_text, source FROM h JOIN papers USING (o)"


def tfidf_retrieval(spark, sf_dir) -> DataFrame:
    found = retrieval.tfidf_retrieve(_papers(spark, sf_dir), _queries(spark, sf_dir), TOP)
    return found.select("query_id", "paper_id", F.round("score", 6).alias("score"))


TFIDF_RETRIEVAL = _PAPERS + r"""
, n AS (SELECT greatest(count(*), 1) AS n FROM papers),
qt AS (SELECT query_id, lower(t) AS token, count(*) AS tf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_\-]+')) AS t FROM benchmark WHERE item_id % 20 = 0) GROUP BY 1, 2),
dt AS (SELECT o, lower(t) AS token, count(*) AS tf FROM (SELECT o, unnest(regexp_extract_all(body, '[A-Za-z0-9_\-]+')) AS t FROM papers) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM dt GROUP BY token),
qw AS (SELECT query_id, token, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM qt LEFT JOIN df USING (token), n),
dw AS (SELECT o, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM dt JOIN df USING (token), n),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY query_id),
dn AS (SELECT o, sqrt(sum(w * w)) AS dn FROM dw GROUP BY o),
p AS (SELECT query_id, o, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (token) GROUP BY query_id, o),
s AS (SELECT query_id, o, round(dot / (qn * dn), 9) AS score FROM p JOIN qn USING (query_id) JOIN dn USING (o))
SELECT query_id, paper_id, round(score, 6) AS score FROM s JOIN papers USING (o) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, o) <= 20
"""


def _index(spark, sf_dir) -> textindex.TextIndex:
    return textindex.TextIndex.build(_papers(spark, sf_dir), f"{new_path(spark, 'text-index')}/index")


def index_keyword_retrieval(spark, sf_dir) -> DataFrame:
    """The keyword search by a stored index."""
    return _index(spark, sf_dir).keyword(_queries(spark, sf_dir), TOP).drop(ORDER)


def index_tfidf_retrieval(spark, sf_dir) -> DataFrame:
    """The TF-IDF search by a stored index."""
    found = _index(spark, sf_dir).tfidf(_queries(spark, sf_dir), TOP)
    return found.select("query_id", "paper_id", F.round("score", 6).alias("score"))


def retrieval_semijoin(spark, sf_dir) -> DataFrame:
    papers = _papers(spark, sf_dir)
    return retrieval.selected(papers, retrieval.retrieve(papers, _queries(spark, sf_dir), TOP)).select("paper_id", "title")


RETRIEVAL_SEMIJOIN = _RETRIEVAL + "SELECT paper_id, title FROM papers WHERE o IN (SELECT o FROM h)"


# Mapping and graph.


def _mapping(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    found = found or staged(_evidence(spark, sf_dir), "evidence")
    return staged(graph.mapped(found, _ready(spark, sf_dir), MAPPING), "mapping")


def variable_map(spark, sf_dir) -> DataFrame:
    out = _mapping(spark, sf_dir).drop(ORDER)
    return out.withColumns({c: F.concat_ws(",", c) for c in ("candidate_variables", "approved_data_features")})


_MAPPING = _EVIDENCE + _OBSERVED.replace("WITH b AS", ", b AS", 1) + """
, ready AS (SELECT DISTINCT feature_name AS c FROM ob WHERE approved AND missing_rate <= 0.62 AND n_available >= 2),
mr(concept, modality, cands) AS (VALUES ('slow-wave generation', 'EEG', ['n_chars', 'source']), ('thalamocortical coupling', 'fMRI', ['quality', 'source']), ('white matter integrity', 'DTI', ['toxic', 'n_chars', 'FA']),
  ('thalamic morphology', 'MRI', ['volume']), ('hyperarousal', 'EEG', ['source'])),
con AS (SELECT mechanism AS concept, min(o * 10 + i) AS first FROM g GROUP BY mechanism),
mp AS (SELECT con.concept, first, coalesce(mr.modality, '') AS modality, coalesce(cands, []) AS cands, list_filter(coalesce(cands, []), lambda x: list_contains(rl, x)) AS own FROM con LEFT JOIN mr ON con.concept = mr.concept, (SELECT coalesce(list(c), []) AS rl FROM ready))
"""
VARIABLE_MAP = _MAPPING + """
SELECT concept, array_to_string(cands, ',') AS candidate_variables, array_to_string(own, ',') AS approved_data_features, modality, CAST(CASE len(own) WHEN 0 THEN 0 WHEN 1 THEN 0.9 ELSE 0.65 END AS DOUBLE) AS mapping_confidence,
  CASE len(own) WHEN 0 THEN 'unavailable' WHEN 1 THEN 'mapped' ELSE 'ambiguous' END AS mapping_status FROM mp
"""


def mapping_gaps(spark, sf_dir) -> DataFrame:
    """Concepts whose mapping is open, with the columns that their list in the report shows."""
    listed = F.when(F.col("mapping_status") == "ambiguous", F.col("approved_data_features")).otherwise(F.col("candidate_variables"))
    return _mapping(spark, sf_dir).filter("mapping_status <> 'mapped'").select("concept", "mapping_status", F.concat_ws(",", listed).alias("listed"))


MAPPING_GAPS = _MAPPING + """
SELECT concept, CASE len(own) WHEN 0 THEN 'unavailable' ELSE 'ambiguous' END AS mapping_status, array_to_string(CASE len(own) WHEN 0 THEN cands ELSE own END, ',') AS listed FROM mp WHERE len(own) <> 1
"""


def grounded_variables(spark, sf_dir) -> DataFrame:
    return graph.grounded_variables(_mapping(spark, sf_dir))


GROUNDED_VARIABLES = _MAPPING + "SELECT DISTINCT unnest(own) AS variable FROM mp"


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = staged(_evidence(spark, sf_dir), "evidence")
    return graph.graph(_papers(spark, sf_dir), found, _mapping(spark, sf_dir, found), CONFOUNDS)


def _shown_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", "label", "node_type", F.coalesce(F.element_at("metadata", "paper_id"), F.element_at("metadata", "evidence_id"), F.lit("")).alias("about"))


def graph_nodes(spark, sf_dir) -> DataFrame:
    return _shown_nodes(_graph(spark, sf_dir)[0])


GRAPH_NODES = _MAPPING + """
SELECT DISTINCT * FROM (SELECT 'paper:' || paper_id AS node_id, split_part(claim, ': ', 1) AS label, 'Paper' AS node_type, paper_id AS about FROM g UNION ALL SELECT 'finding:' || evidence_id, claim, 'Finding', evidence_id FROM g
UNION ALL SELECT 'mechanism:' || mechanism, mechanism, 'Mechanism', '' FROM g UNION ALL SELECT 'variable:' || variable_or_feature, variable_or_feature, 'Variable', '' FROM g UNION ALL SELECT 'modality:' || modality, modality, 'Modality', '' FROM g
UNION ALL SELECT 'data_feature:' || f, f, 'DataFeature', '' FROM (SELECT unnest(own) AS f FROM mp) UNION ALL SELECT 'variable:' || f, f, 'Variable', '' FROM (SELECT unnest(own) AS f FROM mp)
UNION ALL SELECT 'confound:' || c, c, 'Confound', '' FROM (SELECT unnest(['age', 'sex', 'medication']) AS c))
"""


def graph_edges(spark, sf_dir) -> DataFrame:
    return _graph(spark, sf_dir)[1].select("source", "target", "edge_type", "weight")


_EDGES = _MAPPING + """
, va AS (SELECT DISTINCT 'variable:' || v AS v FROM (SELECT variable_or_feature AS v FROM g UNION SELECT unnest(own) FROM mp)),
ce AS (SELECT 'confound:' || c AS source, v AS target, 'confound_affects_variable' AS edge_type, CAST(0.2 AS DOUBLE) AS weight FROM va, (SELECT unnest(['age', 'sex', 'medication']) AS c))
"""
GRAPH_EDGES = _EDGES + """
SELECT 'paper:' || paper_id AS source, 'finding:' || evidence_id AS target, 'paper_reports_finding' AS edge_type, CAST(1 AS DOUBLE) AS weight FROM g
UNION ALL SELECT 'finding:' || evidence_id, 'mechanism:' || mechanism, CASE direction WHEN 'refute' THEN 'finding_refutes_mechanism' ELSE 'finding_supports_mechanism' END, CASE WHEN coalesce(evidence_quality_score, 0) = 0 THEN 1 ELSE evidence_quality_score END FROM g
UNION ALL SELECT 'mechanism:' || mechanism, 'variable:' || variable_or_feature, 'mechanism_measured_by_variable', 1 FROM g UNION ALL SELECT 'variable:' || variable_or_feature, 'modality:' || modality, 'variable_belongs_to_modality', 1 FROM g
UNION ALL SELECT 'variable:' || f, 'data_feature:' || f, 'variable_mapped_to_data_feature', CASE n WHEN 1 THEN 0.9 ELSE 0.65 END FROM (SELECT unnest(own) AS f, len(own) AS n FROM mp) UNION ALL SELECT * FROM ce
"""


def _stored_graph(spark, sf_dir) -> graphstore.GraphStore:
    """The same graph from two batches, English papers and all others."""
    store = graphstore.GraphStore.open(spark, f"{new_path(spark, 'graph-store')}/graph", CONFOUNDS)
    papers = _papers(spark, sf_dir).withColumn("__first", F.element_at("keywords", 1).eqNullSafe("en"))
    ready = staged(_ready(spark, sf_dir), "ready")
    for first in (True, False):
        own = papers.filter(F.col("__first") == first)
        found = staged(evidence.graded(evidence.extracted(own, RULES, "cohort")), "evidence")
        store.add(own, found, staged(graph.mapped(found, ready, MAPPING), "mapping"))
    return store


def graph_batches_nodes(spark, sf_dir) -> DataFrame:
    return _shown_nodes(_stored_graph(spark, sf_dir).nodes())


def graph_batches_edges(spark, sf_dir) -> DataFrame:
    return _stored_graph(spark, sf_dir).edges().select("source", "target", "edge_type", "weight")


def confound_edges(spark, sf_dir) -> DataFrame:
    return graph_edges(spark, sf_dir).filter("edge_type = 'confound_affects_variable'")


CONFOUND_EDGES = _EDGES + "SELECT * FROM ce"


def grounding_outputs(spark, sf_dir) -> DataFrame:
    """All outputs of the grounding plan: documents as papers in JSON Lines, their labels as the merged table, the library's own rules."""
    at = new_path(spark, "grounding-plan")
    d = _t(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 2 == 0, F.format_string("doc%d", "doc_id")).otherwise("")
    papers = d.select(own.alias("paper_id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("abstract"), F.array("lang", "source").alias("keywords"), "source", F.col("doc_id").alias(ORDER))
    rows = _labelled(spark, sf_dir)
    master = rows.select("subject_id", F.col("n_chars").alias("delta_power"), F.col("quality").alias("FA"), F.col("toxic").alias("thalamus_volume"), F.lit("None").alias("ISI"), ORDER)
    kinds = [("delta_power", "EEG", "delta_power", "true"), ("FA", "DTI", "", "no"), ("thalamus_volume", "MRI", "thalamus_volume", "yes"), ("ISI", "Scale", "ISI", "1"), ("gone", "EEG", "gone", "1"), ("beta_power", "EEG", "delta_power", "0")]
    registry = spark.createDataFrame([(*k, i) for i, k in enumerate(kinds)], f"feature_name string, modality string, source_column string, approved string, {ORDER} long")
    sinks.write_json(papers, f"{at}/in/papers.json")
    sinks.write_csv(master, f"{at}/in/master.csv")
    sinks.write_csv(registry, f"{at}/in/registry.csv")
    rules = {"slow-wave generation": ("EEG", ["delta_power", "gone"]), "white matter integrity": ("DTI", ["FA"]), "thalamic morphology": ("MRI", ["thalamus_volume"]), "insomnia severity": ("Scale", ["ISI", "PSQI"])}
    sinks.write_yaml({"mappings": {k: {"modality": m, "candidates": c} for k, (m, c) in rules.items()}}, f"{at}/in/rules.yaml")
    sinks.write_yaml({"confounds": ["age", "medication"]}, f"{at}/in/templates.yaml")
    sinks.write_yaml({"approved_variables": ["FA"]}, f"{at}/in/approved.yaml")
    paths = {
        "seed_papers": "in/none.json", "fixture_seed_papers": "in/papers.json", "feature_registry": "in/registry.csv", "fixture_feature_registry": "in/none.csv", "approved_variables": "in/approved.yaml", "fixture_approved_variables": "in/none.yaml",
        "multimodal_master_table": "in/master.csv", "fixture_multimodal_master_table": "in/none.csv", "mechanism_templates": "in/templates.yaml", "variable_mapping_rules": "in/rules.yaml", "output_grounding_dir": "out", "output_profiles_dir": "out/profiles", "report_path": "out/report.md",
    }
    config = Config({"paths": paths, "data_profile": {"max_missing_rate": 0.7, "min_n_available": 2, "accepted_qc_status": ["pass"]}, "evidence": {"default_population": "cohort"}}, at)
    done = grounding.write(grounding.build(spark, config))
    found = read_records(spark, f"{at}/out/evidence_table.json").select("evidence_id", "paper_id", "modality", "variable_or_feature", "mechanism", "direction", "evidence_type", "population", "evidence_quality_score")
    nodes = read_csv(spark, f"{at}/out/mechanism_graph_nodes.csv").select("node_id", "node_type")
    edges = read_csv(spark, f"{at}/out/mechanism_graph_edges.csv").select("source", "target", "edge_type", "weight")
    out = _lines(found, "evidence").unionByName(_lines(nodes, "nodes")).unionByName(_lines(edges, "edges"))
    told = [("mapping", f"{m['concept']}={m['mapping_status']}:{','.join(m['approved_data_features'])}") for m in read_yaml(f"{at}/out/evidence_to_variable_map.yaml", spark)["mappings"]]
    told += [("grounded", x) for x in read_yaml(f"{at}/out/approved_variables_from_grounding.yaml", spark)["approved_variables"]]
    for name in ("theoretical", "observed", "analysis_ready"):
        features = read_yaml(f"{at}/out/profiles/{name}_profile.yaml", spark)["features"]
        told += [(f"{name}_profile", f"{f['feature_name']}={f['modality']},{str(f['approved']).lower()},{f['n_available'] if f['n_available'] is not None else ''}") for f in features]
    told += [("figures", f"{k}={done[k]}") for k in ("papers", "retrieval_hits", "evidence", "analysis_ready_variables", "graph_nodes", "graph_edges")]
    told += [("report", x) for x in read_text(f"{at}/out/report.md", spark).splitlines() if x.startswith(("- Literature", "- Evidence rec", "- support", "- refute", "- null", "- unclear", "- min", "- max", "- age", "- medication"))]
    return out.unionByName(spark.createDataFrame(told, "artifact string, line string"))


GROUNDING_OUTPUTS = r"""
WITH d AS (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS a, lang || ' ' || source AS title FROM documents),
papers AS (SELECT doc_id AS o, title, CASE WHEN doc_id % 2 = 0 THEN 'doc' || doc_id ELSE 'paper_' || substr(sha1(title || '||' || a || '||'), 1, 12) END AS paper_id, lower(title || ' ' || a || ' ' || lang || ' ' || source || ' ') AS low FROM d),
rules(i, k, m, v, c) AS (VALUES (0, 'slow wave', 'EEG', 'slow_wave_density', 'slow-wave generation'), (1, 'delta', 'EEG', 'delta_power', 'slow-wave generation'), (2, 'spindle', 'EEG', 'spindle_density', 'spindle generation'),
  (3, 'thalamocortical', 'EEG-fMRI', 'thalamus_DMN_FC', 'thalamocortical coupling'), (4, 'default mode network', 'fMRI', 'thalamus_DMN_FC', 'thalamocortical coupling'), (5, 'dmn', 'fMRI', 'thalamus_DMN_FC', 'thalamocortical coupling'),
  (6, 'dti', 'DTI', 'FA', 'white matter integrity'), (7, ' fa', 'DTI', 'FA', 'white matter integrity'), (8, 'mri', 'MRI', 'MRI', 'structural morphology'), (9, 'hippocampus', 'MRI', 'hippocampus_volume', 'hippocampal morphology'),
  (10, 'thalamus', 'MRI', 'thalamus_volume', 'thalamic morphology'), (11, 'isi', 'Scale', 'ISI', 'insomnia severity'), (12, 'psqi', 'Scale', 'PSQI', 'insomnia severity'), (13, 'hyperarousal', 'EEG', 'beta_power', 'hyperarousal'),
  (14, 'beta', 'EEG', 'beta_power', 'hyperarousal'), (15, 'salience', 'fMRI', 'salience_network_FC', 'salience network regulation')),
ev AS (SELECT o, i, paper_id, m, v, c, title, 'evidence_' || substr(sha1(paper_id || '||' || c || '||' || v), 1, 12) AS id,
  CASE WHEN contains(low, 'insomnia') THEN 'insomnia' WHEN contains(low, 'sleep disorder') THEN 'sleep disorder' WHEN contains(low, 'adults') THEN 'adults' ELSE 'cohort' END AS population,
  CASE WHEN regexp_matches(low, 'no association|not associated|null finding') THEN 'null' WHEN regexp_matches(low, 'refute|opposite|lower than expected') THEN 'refute' WHEN regexp_matches(low, 'associated|support|suggest|show|reports|reduced|increased|altered|disrupted') THEN 'support' ELSE 'unclear' END AS dir,
  CASE WHEN regexp_matches(low, 'meta-analysis|meta analysis') THEN 'meta_analysis' WHEN contains(low, 'review') THEN 'review' WHEN contains(low, 'case') THEN 'case' WHEN contains(low, 'method') THEN 'method' WHEN regexp_matches(low, 'empirical|study|findings') THEN 'empirical' ELSE 'unknown' END AS kind,
  regexp_matches(low, 'limitation:\s*\S|small sample|cross-sectional') AS lim FROM papers JOIN rules ON contains(' ' || low || ' ', k)),
g AS (SELECT *, CAST(round(greatest(0, least(1, CASE kind WHEN 'meta_analysis' THEN 90 WHEN 'review' THEN 75 WHEN 'empirical' THEN 80 WHEN 'method' THEN 60 WHEN 'case' THEN 35 ELSE 25 END / 100.0 + 0.11 + CASE WHEN dir <> 'unclear' THEN 0.04 ELSE -0.04 END + CASE WHEN lim THEN 0.03 ELSE 0 END)), 3) AS DOUBLE) AS score FROM ev),
x AS (SELECT doc_id, coalesce(CAST(n_chars AS VARCHAR), '') AS delta, coalesce(CAST(quality AS VARCHAR), '') AS fa, coalesce(CAST(toxic AS VARCHAR), '') AS tv FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT count(*) AS t, count(*) FILTER (delta <> '') AS delta, count(*) FILTER (fa <> '') AS fa, count(*) FILTER (tv <> '') AS tv FROM x),
ob AS (SELECT unnest([{'f': 'delta_power', 'm': 'EEG', 'ok': true, 'n': delta}, {'f': 'FA', 'm': 'DTI', 'ok': true, 'n': fa}, {'f': 'thalamus_volume', 'm': 'MRI', 'ok': true, 'n': tv}, {'f': 'ISI', 'm': 'Scale', 'ok': true, 'n': 0}, {'f': 'gone', 'm': 'EEG', 'ok': true, 'n': NULL},
  {'f': 'beta_power', 'm': 'EEG', 'ok': false, 'n': delta}], recursive := true), t FROM n),
re AS (SELECT * FROM ob WHERE ok AND (n IS NULL OR n >= 2 AND round(1.0 - n / t, 3) <= 0.7)),
mr(c, l) AS (VALUES ('slow-wave generation', ['delta_power', 'gone']), ('white matter integrity', ['FA']), ('thalamic morphology', ['thalamus_volume']), ('insomnia severity', ['ISI', 'PSQI'])),
mp AS (SELECT z.c, list_filter(coalesce(l, []), lambda y: list_contains(rl, y)) AS own FROM (SELECT DISTINCT c FROM g) AS z LEFT JOIN mr ON mr.c = z.c, (SELECT coalesce(list(f), []) AS rl FROM re)),
nd AS (SELECT 'paper:' || paper_id AS id, 'Paper' AS k FROM g UNION SELECT 'finding:' || id, 'Finding' FROM g UNION SELECT 'mechanism:' || c, 'Mechanism' FROM g UNION SELECT 'variable:' || v, 'Variable' FROM g UNION SELECT 'modality:' || m, 'Modality' FROM g
  UNION SELECT 'data_feature:' || unnest(own), 'DataFeature' FROM mp UNION SELECT 'variable:' || unnest(own), 'Variable' FROM mp UNION SELECT 'confound:' || unnest(['age', 'medication']), 'Confound'),
ed AS (SELECT 'paper:' || paper_id AS s, 'finding:' || id AS t, 'paper_reports_finding' AS k, CAST(1 AS DOUBLE) AS w FROM g UNION ALL SELECT 'finding:' || id, 'mechanism:' || c, CASE dir WHEN 'refute' THEN 'finding_refutes_mechanism' ELSE 'finding_supports_mechanism' END, CASE WHEN score = 0 THEN 1 ELSE score END FROM g
  UNION ALL SELECT 'mechanism:' || c, 'variable:' || v, 'mechanism_measured_by_variable', 1 FROM g UNION ALL SELECT 'variable:' || v, 'modality:' || m, 'variable_belongs_to_modality', 1 FROM g
  UNION ALL SELECT 'variable:' || f, 'data_feature:' || f, 'variable_mapped_to_data_feature', CASE q WHEN 1 THEN 0.9 ELSE 0.65 END FROM (SELECT unnest(own) AS f, len(own) AS q FROM mp)
  UNION ALL SELECT 'confound:' || y, nd.id, 'confound_affects_variable', 0.2 FROM nd, (SELECT unnest(['age', 'medication']) AS y) WHERE nd.k = 'Variable')
SELECT 'evidence' AS artifact, 'direction=' || dir || '|evidence_id=' || id || '|evidence_quality_score=' || score || '|evidence_type=' || kind || '|mechanism=' || c || '|modality=' || m || '|paper_id=' || paper_id || '|population=' || population || '|variable_or_feature=' || v AS line FROM g
UNION ALL SELECT 'nodes', 'node_id=' || id || '|node_type=' || k FROM nd UNION ALL SELECT 'edges', 'edge_type=' || k || '|source=' || s || '|target=' || t || '|weight=' || w FROM ed
UNION ALL SELECT 'mapping', c || '=' || CASE len(own) WHEN 0 THEN 'unavailable' WHEN 1 THEN 'mapped' ELSE 'ambiguous' END || ':' || array_to_string(own, ',') FROM mp UNION ALL SELECT DISTINCT 'grounded', unnest(own) FROM mp
UNION ALL SELECT 'theoretical_profile', v || '=' || arg_min(m, o * 100 + i) || ',false,' FROM g GROUP BY v UNION ALL SELECT 'observed_profile', f || '=' || m || ',' || ok || ',' || coalesce(CAST(n AS VARCHAR), '') FROM ob
UNION ALL SELECT 'analysis_ready_profile', f || '=' || m || ',' || ok || ',' || coalesce(CAST(n AS VARCHAR), '') FROM re
UNION ALL SELECT 'figures', k || '=' || v FROM (SELECT 'papers' AS k, count(*) AS v FROM papers UNION ALL SELECT 'retrieval_hits', 0 UNION ALL SELECT 'evidence', count(*) FROM g UNION ALL SELECT 'analysis_ready_variables', count(*) FROM re UNION ALL SELECT 'graph_nodes', count(*) FROM nd UNION ALL SELECT 'graph_edges', count(*) FROM ed)
UNION ALL SELECT 'report', '- Literature records: ' || count(*) FROM papers UNION ALL SELECT 'report', '- Evidence records: ' || count(*) FROM g UNION ALL SELECT 'report', unnest(['- age', '- medication'])
UNION ALL SELECT 'report', '- ' || y || ': ' || (SELECT count(*) FROM g WHERE dir = y) FROM (SELECT unnest(['support', 'refute', 'null', 'unclear']) AS y)
UNION ALL SELECT 'report', printf('- min: %.3f', min(score)) FROM g HAVING count(*) > 0 UNION ALL SELECT 'report', printf('- max: %.3f', max(score)) FROM g HAVING count(*) > 0
"""

QUERIES = {
    f.__name__: f
    for f in (
        entity_index, qc_status_normalize, qc_counts_by_modality, worst_status_by_entity, master_merge, master_merge_log, master_merge_found, coverage_counts, modality_summary, foundation_outputs, data_dictionary_roles, csv_round_trip, json_round_trip, qc_histogram, group_sizes, role_approval,
        approved_totals, foundation_warnings, feature_counts, mapping_gaps, column_profile, feature_approval, approved_buckets, data_dictionary, missing_topk,
        observed_profile, analysis_ready, literature_normalize, evidence_extract, evidence_grade, evidence_rule_table, evidence_direction_counts, evidence_quality_summary, theoretical_profile, keyword_retrieval, tfidf_retrieval,
        index_keyword_retrieval, index_tfidf_retrieval, retrieval_semijoin, variable_map, grounded_variables, graph_nodes, graph_edges, graph_batches_nodes, graph_batches_edges, confound_edges, grounding_outputs,
    )
}
ORACLES = {
    "entity_index": ENTITY_INDEX, "qc_status_normalize": QC_STATUS_NORMALIZE, "qc_counts_by_modality": QC_COUNTS, "worst_status_by_entity": WORST_STATUS, "master_merge": MASTER_MERGE, "master_merge_log": MASTER_MERGE_LOG,
    "master_merge_found": MASTER_MERGE_FOUND, "coverage_counts": COVERAGE_COUNTS, "modality_summary": MODALITY_SUMMARY, "foundation_outputs": FOUNDATION_OUTPUTS, "data_dictionary_roles": DATA_DICTIONARY_ROLES, "csv_round_trip": CSV_ROUND_TRIP, "json_round_trip": JSON_ROUND_TRIP,
    "qc_histogram": QC_HISTOGRAM, "group_sizes": GROUP_SIZES, "role_approval": ROLE_APPROVAL, "approved_totals": APPROVED_TOTALS,
    "foundation_warnings": FOUNDATION_WARNINGS, "feature_counts": FEATURE_COUNTS, "mapping_gaps": MAPPING_GAPS,
    "column_profile": COLUMN_PROFILE, "feature_approval": FEATURE_APPROVAL, "approved_buckets": APPROVED_BUCKETS, "data_dictionary": DATA_DICTIONARY, "missing_topk": MISSING_TOPK, "observed_profile": OBSERVED_PROFILE,
    "analysis_ready": ANALYSIS_READY, "literature_normalize": LITERATURE_NORMALIZE, "evidence_extract": EVIDENCE_EXTRACT, "evidence_grade": EVIDENCE_GRADE, "evidence_rule_table": EVIDENCE_RULE_TABLE, "evidence_direction_counts": EVIDENCE_DIRECTION_COUNTS,
    "evidence_quality_summary": EVIDENCE_QUALITY_SUMMARY, "theoretical_profile": THEORETICAL_PROFILE, "keyword_retrieval": KEYWORD_RETRIEVAL, "tfidf_retrieval": TFIDF_RETRIEVAL, "index_keyword_retrieval": KEYWORD_RETRIEVAL, "index_tfidf_retrieval": TFIDF_RETRIEVAL, "retrieval_semijoin": RETRIEVAL_SEMIJOIN,
    "variable_map": VARIABLE_MAP, "grounded_variables": GROUNDED_VARIABLES, "graph_nodes": GRAPH_NODES, "graph_edges": GRAPH_EDGES, "graph_batches_nodes": GRAPH_NODES, "graph_batches_edges": GRAPH_EDGES, "confound_edges": CONFOUND_EDGES, "grounding_outputs": GROUNDING_OUTPUTS,
}
