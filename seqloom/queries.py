"""Queries on the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.parsers import parser
from seqloom.functions.text import masked
from seqloom.operators import labels as L
from seqloom.operators.bayes import BERNOULLI, COMPLEMENT, MULTINOMIAL, NaiveBayes
from seqloom.operators.clusters import ClusteredContexts
from seqloom.operators.contexts import NO_EVENT, ContextModel, contexts, next_candidates, reason, top_templates
from seqloom.operators.frequency import TemplateFrequency
from seqloom.operators.metrics import FULL_DATASET, TRAIN_ONLY, decision_summary, label_histograms, next_event_metrics, run_metrics
from seqloom.operators.next_event import KeyModel, ParameterModel, history_pairs, normal_training, normalisation, parameter_schema, parameter_values, predict_jointly
from seqloom.operators.online_bayes import OnlineNaiveBayes
from seqloom.operators.representations import phrase_counts, represented, sequential, template_counts
from seqloom.operators.sequences import EntitySequences, FixedWindows, SequenceBuilder, Sequences, TimeWindows, entity_ids, nested, split_summary, with_time_gaps
from seqloom.operators.templates import DrainParser, IdentityParser
from seqloom.sources.store import first_row_example, timestamp_bounds
from seqloom.storage import kept
from seqloom.views import events_as_log, no_labels, table

QUERIES = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000

LOG = """
log AS (
  SELECT epoch_us(ts) // 1000 AS ts_ms, concat(CAST(user_id AS VARCHAR), '@', strftime(ts, '%Y-%m-%d')) AS entity_id,
         concat_ws(' ', event_type, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), props) AS text,
         CAST(CASE WHEN event_type = 'error' AND value > 20 THEN 1 ELSE 0 END AS BIGINT) AS anomalous, event_id AS line_order,
         event_type AS template, CAST(floor(value * 100) AS BIGINT) AS cents,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS key
  FROM events)"""
ENTITIES = f"""{LOG},
glabel AS (SELECT entity_id, arg_min(anomalous, line_order) AS glabel FROM log WHERE anomalous <> 0 GROUP BY entity_id),
ent AS (
  SELECT entity_id, row_number() OVER (ORDER BY first_ts NULLS LAST, first_line, entity_id) - 1 AS window_id
  FROM (SELECT entity_id, arg_min_null(ts_ms, line_order) AS first_ts, min(line_order) AS first_line FROM log GROUP BY entity_id)),
members AS (
  SELECT log.*, window_id, coalesce(glabel, 0) AS glabel, row_number() OVER (PARTITION BY window_id ORDER BY line_order) - 1 AS pos
  FROM log JOIN ent USING (entity_id) LEFT JOIN glabel USING (entity_id)),
n AS (SELECT count(*) AS total, CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS want FROM ent),
c AS (SELECT total, CAST(least(total, ceil(CAST(0.5 AS DOUBLE) * total)) AS BIGINT) AS n_test, want FROM n),
counts AS (SELECT total, n_test, least(total - n_test, CAST(ceil(CAST(0.3 AS DOUBLE) * total) AS BIGINT)) AS n_train FROM c),
seq AS (
  SELECT window_id, max(CAST(anomalous <> 0 OR glabel <> 0 AS INTEGER)) AS label, count(*) AS event_count,
         min(line_order) AS first_line, max(line_order) AS last_line, max(glabel) AS glabel FROM members GROUP BY window_id),
split AS (
  SELECT seq.*, CASE WHEN window_id >= total - n_test THEN 'test' WHEN window_id < n_train THEN 'train' ELSE 'ignored' END AS split_label
  FROM seq, counts),
pool AS (
  SELECT seq.*, window_id < total - n_test AS in_pool, n_train,
         coalesce(sum(CASE WHEN window_id < total - n_test AND glabel = 0 AND label = 0 THEN 1 ELSE 0 END)
                  OVER (ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
  FROM seq, counts),
normal_split AS (
  SELECT window_id, label, event_count, first_line, last_line,
         CASE WHEN NOT in_pool THEN 'test' WHEN glabel = 0 AND taken < n_train THEN 'train' ELSE 'ignored' END AS split_label
  FROM pool)"""
TRAINING = """
train AS (SELECT m.* FROM members m JOIN split s USING (window_id) WHERE split_label = 'train')"""


def query(sql: str | None = None):
    """Registers a query by its function's name, with the SQL that it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def entities(spark: SparkSession, sf_dir: str, normal_only: bool = False) -> EntitySequences:
    rows = events_as_log(spark, sf_dir)
    return EntitySequences(rows, L.inline_group_labels(rows), 0.3, 0.5, train_on_normal_entities_only=normal_only)


def sequence_rows(builder: SequenceBuilder) -> DataFrame:
    return builder.build().sequences.select("window_id", "label", "event_count", "first_line", "last_line", "split_label")


@query("SELECT count(*) AS n_rows FROM events")
def row_count(spark, sf_dir):
    return events_as_log(spark, sf_dir).agg(F.count("*").alias("n_rows"))


@query(f"WITH {LOG} SELECT line_order, text AS untemplated_message_text FROM log ORDER BY line_order LIMIT 1")
def first_line_example(spark, sf_dir):
    return first_row_example(events_as_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM log")
def log_time_bounds(spark, sf_dir):
    return timestamp_bounds(events_as_log(spark, sf_dir))


@query(f"WITH {ENTITIES} SELECT count(*) FILTER (glabel.glabel IS NULL) AS normal_entities, count(*) AS total_entities FROM ent LEFT JOIN glabel USING (entity_id)")
def entity_label_counts(spark, sf_dir):
    rows = events_as_log(spark, sf_dir)
    return L.count_entities_by_label(rows, L.inline_group_labels(rows))


@query(f"WITH {LOG} SELECT line_order, anomalous AS label FROM log WHERE anomalous <> 0")
def inline_line_labels(spark, sf_dir):
    return L.inline_line_labels(events_as_log(spark, sf_dir))


@query(f"WITH {ENTITIES} SELECT entity_id, glabel AS label FROM glabel")
def inline_group_labels(spark, sf_dir):
    return L.inline_group_labels(events_as_log(spark, sf_dir))


@query("""
WITH raw AS (SELECT doc_id, CAST(doc_id % 50 AS VARCHAR) AS entity_id, CASE quality WHEN 1 THEN 'normal' ELSE CASE WHEN doc_id % 3 = 0 THEN '2' WHEN doc_id % 3 = 1 THEN 'anomaly' ELSE 'nope' END END AS t FROM labels),
v AS (SELECT entity_id, doc_id, CASE WHEN t = 'normal' THEN 0 WHEN t = 'anomaly' THEN 1 ELSE TRY_CAST(t AS BIGINT) END AS label FROM raw)
SELECT entity_id, CAST(arg_max(label, doc_id) AS BIGINT) AS label FROM v WHERE label IS NOT NULL GROUP BY entity_id""")
def mapped_text_labels(spark, sf_dir):
    odd = F.when(F.col("doc_id") % 3 == 0, "2").when(F.col("doc_id") % 3 == 1, " Anomaly").otherwise("nope")
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 50).cast("string").alias("entity_id"), F.when(F.col("quality") == 1, " Normal ").otherwise(odd).alias("label"))
    return L.mapped_labels(rows, "entity_id", "label", "doc_id")


@query(f"WITH {ENTITIES} SELECT entity_id, window_id FROM ent")
def entity_chronology(spark, sf_dir):
    return entities(spark, sf_dir).chronology().select("entity_id", "window_id")


@query(f"WITH {ENTITIES} SELECT window_id, label, event_count, first_line, last_line, split_label FROM split")
def entity_sequences(spark, sf_dir):
    return sequence_rows(entities(spark, sf_dir))


@query(f"WITH {ENTITIES} SELECT window_id, label, event_count, first_line, last_line, split_label FROM normal_split")
def entity_sequences_normal_only(spark, sf_dir):
    return sequence_rows(entities(spark, sf_dir, normal_only=True))


@query(f"""WITH {ENTITIES}, t AS (SELECT *, CASE WHEN line_order % 5 = 0 THEN NULL ELSE ts_ms END AS t FROM members)
SELECT line_order, window_id, t - last_value(t IGNORE NULLS) OVER (PARTITION BY window_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dt_prev_ms FROM t""")
def time_gaps(spark, sf_dir):
    members = entities(spark, sf_dir).build().members
    members = members.withColumn("timestamp_unix_ms", F.when(F.col("line_order") % 5 != 0, F.col("timestamp_unix_ms")))
    return with_time_gaps(members).select("line_order", "window_id", "dt_prev_ms")


def fixed_sql(size: int, step: int | None) -> str:
    e, raw = min(step or size, size), step or size
    return f"""WITH {LOG},
r AS (SELECT *, row_number() OVER (ORDER BY line_order) - 1 AS rn FROM log),
n AS (SELECT count(*) AS n, CASE WHEN count(*) <= {size} THEN 1 ELSE 1 + CAST(ceil(CAST(count(*) - {size} AS DOUBLE) / {raw}) AS BIGINT) END AS counted FROM log),
k AS (SELECT n, counted, CASE WHEN (CASE WHEN n < {size} THEN 0 ELSE (n - {size}) // {e} + 1 END) * {e} < n THEN (CASE WHEN n < {size} THEN 0 ELSE (n - {size}) // {e} + 1 END) ELSE (CASE WHEN n < {size} THEN 0 ELSE (n - {size}) // {e} + 1 END) - 1 END AS last FROM n),
m AS (SELECT r.*, w.window_id FROM r, k, range(0, (SELECT last + 1 FROM k)) w(window_id) WHERE rn >= w.window_id * {e} AND rn < w.window_id * {e} + {size}),
g AS (SELECT entity_id, max(anomalous) AS glabel FROM log GROUP BY entity_id),
s AS (SELECT window_id, max(CAST(anomalous <> 0 OR glabel <> 0 AS INTEGER)) AS label, count(*) AS event_count, min(line_order) AS first_line, max(line_order) AS last_line FROM m JOIN g USING (entity_id) GROUP BY window_id),
c AS (SELECT counted, least(counted, CAST(ceil(CAST(0.25 AS DOUBLE) * counted) AS BIGINT)) AS n_test FROM k)
SELECT window_id, label, event_count, first_line, last_line,
  CASE WHEN window_id >= counted - n_test THEN 'test' WHEN window_id < least(counted - n_test, CAST(ceil(CAST(0.34 AS DOUBLE) * counted) AS BIGINT)) THEN 'train' ELSE 'ignored' END AS split_label
FROM s, c"""


def fixed(spark, sf_dir, size: int, step: int | None) -> FixedWindows:
    rows = events_as_log(spark, sf_dir)
    return FixedWindows(rows, L.inline_group_labels(rows), 0.34, 0.25, size=size, step=step)


@query(fixed_sql(50, None))
def fixed_windows_tumbling(spark, sf_dir):
    return sequence_rows(fixed(spark, sf_dir, 50, None))


@query(fixed_sql(50, 20))
def fixed_windows_sliding(spark, sf_dir):
    return sequence_rows(fixed(spark, sf_dir, 50, 20))


@query(fixed_sql(50, 70))
def fixed_windows_wide_step(spark, sf_dir):
    return sequence_rows(fixed(spark, sf_dir, 50, 70))


def time_sql(span: int, step: int | None, select: str | None = None, log: str = LOG, group_label: str = "max(anomalous)") -> str:
    raw = step or span
    final = select or """SELECT window_id, label, event_count, first_line, last_line,
  CASE WHEN window_id >= counted - n_test THEN 'test' WHEN window_id < n_train THEN 'train' ELSE 'ignored' END AS split_label FROM s, c"""
    return f"""WITH {log},
b AS (SELECT min(ts_ms) AS a, max(ts_ms) AS z, CASE WHEN max(ts_ms) - min(ts_ms) < {span} THEN 1 ELSE (max(ts_ms) - min(ts_ms) - {span}) // {raw} + 1 END AS counted FROM log),
w AS (SELECT k, CASE WHEN k = 0 OR {raw} <= {span} THEN a + k * {raw} ELSE a + (k - 1) * {raw} + {span} END AS lo, a + k * {raw} + {span} AS hi FROM b, range(0, (SELECT (z - a) // {raw} + 1 FROM b)) r(k)),
g AS (SELECT entity_id, {group_label} AS glabel FROM log GROUP BY entity_id),
m AS (SELECT log.*, k, glabel FROM w JOIN log ON ts_ms >= lo AND ts_ms < hi JOIN g USING (entity_id)),
mm AS (SELECT m.*, dense_rank() OVER (ORDER BY k) - 1 AS window_id FROM m),
s AS (SELECT window_id, max(CAST(anomalous <> 0 OR glabel <> 0 AS INTEGER)) AS label, count(*) AS event_count, min(line_order) AS first_line, max(line_order) AS last_line FROM mm GROUP BY window_id),
c0 AS (SELECT counted, least(counted, CAST(ceil(CAST(0.25 AS DOUBLE) * counted) AS BIGINT)) AS n_test FROM b),
c AS (SELECT counted, n_test, least(counted - n_test, CAST(ceil(CAST(0.34 AS DOUBLE) * counted) AS BIGINT)) AS n_train FROM c0)
{final}"""


def timed(spark, sf_dir, span: int, step: int | None) -> TimeWindows:
    rows = events_as_log(spark, sf_dir)
    return TimeWindows(rows, L.inline_group_labels(rows), 0.34, 0.25, span=span, step=step)


@query(time_sql(24 * HOUR, None))
def time_windows_tumbling(spark, sf_dir):
    return sequence_rows(timed(spark, sf_dir, 24 * HOUR, None))


@query(time_sql(24 * HOUR, 12 * HOUR))
def time_windows_sliding(spark, sf_dir):
    return sequence_rows(timed(spark, sf_dir, 24 * HOUR, 12 * HOUR))


@query(time_sql(HOUR, 2 * HOUR))
def time_windows_gap(spark, sf_dir):
    return sequence_rows(timed(spark, sf_dir, HOUR, 2 * HOUR))


@query(time_sql(24 * HOUR, 12 * HOUR, "SELECT counted AS total, n_train AS train, counted - n_train - n_test AS ignored, n_test AS test FROM c"))
def window_split_counts(spark, sf_dir):
    c = timed(spark, sf_dir, 24 * HOUR, 12 * HOUR).build().counts
    return spark.createDataFrame([(c.total, c.train, c.ignored, c.test)], "total long, train long, ignored long, test long")


@query(f"""WITH {ENTITIES}, s AS (
  SELECT count(*) AS n, count(*) FILTER (split_label = 'train') AS tr, count(*) FILTER (split_label = 'ignored') AS ig,
         count(*) FILTER (split_label = 'ignored' AND label <> 0) AS bad, count(*) FILTER (split_label <> 'test' AND label = 0) AS good FROM normal_split)
SELECT CAST(0.3 AS DOUBLE) AS requested_train_fraction, CAST(0.5 AS DOUBLE) AS requested_test_fraction, true AS train_on_normal_entities_only,
  tr + ig AS train_pool_sequence_count, bad AS ineligible_train_pool_count, tr AS realised_train_sequence_count, ig AS excluded_from_train_count,
  good AS eligible_train_sequence_count, ig AS ignored_sequence_count, round(coalesce(CAST(tr AS DOUBLE) / nullif(good, 0), 0), 8) AS effective_train_fraction_of_eligible,
  round(coalesce(CAST(tr AS DOUBLE) / nullif(n, 0), 0), 8) AS effective_train_fraction_overall FROM s""")
def entity_split_summary(spark, sf_dir):
    builder = entities(spark, sf_dir, normal_only=True)
    return split_summary(builder.build(), builder)


@query(time_sql(24 * HOUR, 12 * HOUR, """, o AS (SELECT window_id, entity_id, row_number() OVER (PARTITION BY window_id ORDER BY min(ts_ms), min(line_order)) AS i FROM mm GROUP BY window_id, entity_id)
SELECT window_id, string_agg(entity_id, ',' ORDER BY i) AS entity_ids, count(*) AS n_entities FROM o GROUP BY window_id"""))
def sequence_entity_ids(spark, sf_dir):
    rows = entity_ids(timed(spark, sf_dir, 24 * HOUR, 12 * HOUR).build().members)
    return rows.select("window_id", F.array_join("entity_ids", ",").alias("entity_ids"), F.size("entity_ids").cast("long").alias("n_entities"))


@query(f"WITH {ENTITIES} SELECT window_id, string_agg(CAST(anomalous AS VARCHAR), ',' ORDER BY pos) AS event_labels, string_agg(template || '/' || coalesce(CAST(cents AS VARCHAR), ''), ',' ORDER BY pos) AS events FROM members GROUP BY window_id")
def nested_sequences(spark, sf_dir):
    rows = nested(entities(spark, sf_dir).build())
    labels = F.array_join(F.transform("event_labels", lambda x: x.cast("string")), ",")
    return rows.select("window_id", labels.alias("event_labels"), F.array_join(F.transform("events", lambda e: F.concat(e["template"], F.lit("/"), F.get(e["params"], F.lit(0)))), ",").alias("events"))


@query(f"WITH {ENTITIES} SELECT window_id, string_agg(template, ' ' ORDER BY pos) AS templates FROM members GROUP BY window_id")
def sequential_representation(spark, sf_dir):
    return sequential(entities(spark, sf_dir).build().members).select("window_id", F.array_join("templates", " ").alias("templates"))


@query(f"WITH {ENTITIES} SELECT window_id, template AS feature, count(*) AS cnt FROM members GROUP BY ALL")
def template_count_features(spark, sf_dir):
    return template_counts(entities(spark, sf_dir).build().members)


@query(f"""WITH {ENTITIES}, tr AS (SELECT window_id, lag(template) OVER (PARTITION BY window_id ORDER BY pos) || ' > ' || template AS feature FROM members)
SELECT window_id, feature, count(*) AS cnt FROM tr WHERE feature IS NOT NULL GROUP BY ALL""")
def transition_features(spark, sf_dir):
    """Features of a registered representation that carries its state over a sequence's batches."""
    return represented(entities(spark, sf_dir).build().members, "transitions")


PHRASES = """
tok AS (SELECT window_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM members),
ph AS (
  SELECT window_id, norm AS feature FROM tok UNION ALL SELECT window_id, unnest(t) FROM tok
  UNION ALL SELECT window_id, t[i] || ' ' || t[i + 1] FROM tok, range(1, len(t)) r(i)),
pc AS (SELECT window_id, feature, count(*) AS cnt FROM ph GROUP BY ALL)"""


def message_members(spark, sf_dir):
    """Members whose templates are the whole messages."""
    built = entities(spark, sf_dir).build()
    return IdentityParser().transform(built.members), built.sequences


@query(f"WITH {ENTITIES}, {PHRASES} SELECT window_id, feature, cnt FROM pc")
def phrase_count_features(spark, sf_dir):
    return phrase_counts(message_members(spark, sf_dir)[0])


@query(f"WITH {ENTITIES}, {TRAINING} SELECT template, count(*) AS cnt FROM train GROUP BY template")
def template_frequency_fit(spark, sf_dir):
    built = entities(spark, sf_dir).build()
    return TemplateFrequency().fit(built.members, built.sequences).counts


TF = f"""{ENTITIES}, {TRAINING},
cnt AS (SELECT template, count(*) AS cnt FROM train GROUP BY template), tot AS (SELECT sum(cnt) AS total, count(*) AS v FROM cnt),
own AS (SELECT window_id, template, count(*) AS n FROM members GROUP BY ALL),
sc AS (SELECT window_id, round(sum(-ln((coalesce(cnt, 0) + 1.0::DOUBLE) / (total + 1.0::DOUBLE * v)) * n) / sum(n), 10) AS score FROM own LEFT JOIN cnt USING (template), tot GROUP BY window_id),
scored AS (SELECT split.*, score FROM split JOIN sc USING (window_id)),
rk AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM scored WHERE split_label = 'train' AND label = 0),
thr AS (SELECT min(score) AS threshold FROM rk WHERE r >= greatest(1, ceil(CAST(0.95 AS DOUBLE) * n))),
tfp AS (SELECT scored.*, CAST(score > threshold AS INTEGER) AS predicted_label FROM scored, thr)"""


@query(f"WITH {TF} SELECT threshold FROM thr")
def template_frequency_threshold(spark, sf_dir):
    built = entities(spark, sf_dir).build()
    return spark.createDataFrame([(TemplateFrequency().fit(built.members, built.sequences).threshold,)], "threshold double")


def frequency_predictions(spark, sf_dir) -> DataFrame:
    built = entities(spark, sf_dir).build()
    return TemplateFrequency().fit(built.members, built.sequences).predict(built.members, built.sequences)


@query(f"WITH {TF} SELECT window_id, split_label, label, round(score, 8) AS score, predicted_label FROM tfp")
def template_frequency_predictions(spark, sf_dir):
    return frequency_predictions(spark, sf_dir).select("window_id", "split_label", "label", F.round("score", 8).alias("score"), "predicted_label")


METRICS = """
cells AS (SELECT count(*) FILTER (label <> 0 AND predicted_label <> 0) AS tp, count(*) FILTER (label = 0 AND predicted_label = 0) AS tn, count(*) FILTER (label = 0 AND predicted_label <> 0) AS fp, count(*) FILTER (label <> 0 AND predicted_label = 0) AS fn, CAST(0 AS BIGINT) AS abstained, avg(score) AS ms FROM {p} WHERE split_label = 'test'),
pr AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r FROM cells)
SELECT tp, tn, fp, fn, abstained, round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0), 8) AS accuracy, round(p, 8) AS precision, round(r, 8) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 8) AS f1, round(coalesce(ms, 0), 8) AS mean_score FROM pr"""


@query(f"WITH {TF}, {METRICS.format(p='tfp')}")
def template_frequency_metrics(spark, sf_dir):
    return run_metrics(frequency_predictions(spark, sf_dir))


QUERIES["run_metrics"], ORACLES["run_metrics"] = QUERIES.pop("template_frequency_metrics"), ORACLES.pop("template_frequency_metrics")


@query(f"WITH {ENTITIES} SELECT split_label, label, count(*) AS n FROM split GROUP BY ALL")
def split_label_histograms(spark, sf_dir):
    return label_histograms(entities(spark, sf_dir).build().sequences)


NB = f"""{ENTITIES}, {PHRASES},
tl AS (SELECT window_id, CAST(label <> 0 AS INTEGER) AS y FROM split WHERE split_label = 'train'),
nc AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM tl),
fc AS (SELECT feature, sum(CASE WHEN y = 0 THEN {{one}} ELSE 0 END) AS c0, sum(CASE WHEN y = 1 THEN {{one}} ELSE 0 END) AS c1 FROM pc JOIN tl USING (window_id) GROUP BY feature),
ft AS (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS v FROM fc)"""
MN = NB.format(one="cnt") + """,
w AS (SELECT pc.window_id, feature, cnt, ln((coalesce(c0, 0) + 1.0::DOUBLE) / (t0 + 1.0::DOUBLE * v)) AS l0, ln((coalesce(c1, 0) + 1.0::DOUBLE) / (t1 + 1.0::DOUBLE * v)) AS l1 FROM pc LEFT JOIN fc USING (feature), ft)"""
POSTERIOR = "round(exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))), 8)"


def bayes(spark, sf_dir, form: str):
    members, sequences = message_members(spark, sf_dir)
    features = kept(phrase_counts(members))
    return features, sequences, NaiveBayes(form).fit(features, sequences)


@query(f"WITH {NB.format(one='cnt')} SELECT feature, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1 FROM fc")
def naive_bayes_fit(spark, sf_dir):
    return bayes(spark, sf_dir, MULTINOMIAL)[2].counts


@query(f"""WITH {MN}, s AS (SELECT window_id, sum(cnt * l0) + ln(n0 / (n0 + n1)) AS s0, sum(cnt * l1) + ln(n1 / (n0 + n1)) AS s1 FROM w, nc GROUP BY window_id, n0, n1)
SELECT window_id, {POSTERIOR} AS score FROM s""")
def naive_bayes_scores(spark, sf_dir):
    features, sequences, model = bayes(spark, sf_dir, MULTINOMIAL)
    return model.predict(features, sequences).select("window_id", F.round("score", 8).alias("score"))


@query(f"""WITH {MN}, s AS (SELECT window_id, sum(cnt * l0) + ln(n0 / (n0 + n1)) AS s0, sum(cnt * l1) + ln(n1 / (n0 + n1)) AS s1 FROM w, nc GROUP BY window_id, n0, n1),
p AS (SELECT window_id, CASE WHEN round(exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))), 10) >= 0.5 THEN 1 ELSE -1 END AS sign FROM s),
k AS (SELECT window_id, feature, round(cnt * (l1 - l0) * sign, 10) AS lean, length(feature) - length(replace(feature, ' ', '')) + 1 AS tokens FROM w JOIN p USING (window_id)),
a AS (SELECT *, max(CAST(lean > 0 AS INTEGER)) OVER (PARTITION BY window_id) AS positive FROM k)
SELECT window_id, CAST(row_number() OVER (PARTITION BY window_id ORDER BY round(lean * tokens, 8) DESC, lean DESC, tokens DESC, feature DESC) AS INTEGER) AS rank, feature FROM a WHERE positive = 0 OR lean > 0 QUALIFY rank <= 5""")
def naive_bayes_key_phrases(spark, sf_dir):
    features, sequences, model = bayes(spark, sf_dir, MULTINOMIAL)
    return model.key_phrases(features, model.predict(features, sequences))


@query(f"""WITH {NB.format(one='1')},
b AS (SELECT sum(ln(1 - (c0 + 1.0::DOUBLE) / (n0 + 2))) AS b0, sum(ln(1 - (c1 + 1.0::DOUBLE) / (n1 + 2))) AS b1 FROM fc, nc),
x AS (SELECT window_id, sum(ln((c0 + 1.0::DOUBLE) / (n0 + 2)) - ln(1 - (c0 + 1.0::DOUBLE) / (n0 + 2))) AS x0, sum(ln((c1 + 1.0::DOUBLE) / (n1 + 2)) - ln(1 - (c1 + 1.0::DOUBLE) / (n1 + 2))) AS x1 FROM pc JOIN fc USING (feature), nc GROUP BY window_id),
s AS (SELECT window_id, coalesce(x0, 0) + b0 + ln(n0 / (n0 + n1)) AS s0, coalesce(x1, 0) + b1 + ln(n1 / (n0 + n1)) AS s1 FROM split LEFT JOIN x USING (window_id), b, nc)
SELECT window_id, {POSTERIOR} AS score FROM s""")
def bernoulli_bayes_scores(spark, sf_dir):
    features, sequences, model = bayes(spark, sf_dir, BERNOULLI)
    return model.predict(features, sequences).select("window_id", F.round("score", 8).alias("score"))


@query(f"WITH {MN}, s AS (SELECT window_id, sum(cnt * -l1) AS s0, sum(cnt * -l0) AS s1 FROM w GROUP BY window_id) SELECT window_id, {POSTERIOR} AS score FROM s")
def complement_bayes_scores(spark, sf_dir):
    features, sequences, model = bayes(spark, sf_dir, COMPLEMENT)
    return model.predict(features, sequences).select("window_id", F.round("score", 8).alias("score"))


#: What a learner knows before each training sequence: counts of phrases, classes and the vocabulary.
PROGRESS = NB.format(one="cnt") + """,
po AS (SELECT pc.window_id, y, feature, {x} AS x FROM pc JOIN tl USING (window_id)),
kn AS (SELECT po.*, coalesce(sum(CASE WHEN y = 0 THEN x ELSE 0 END) OVER o, 0) AS c0, coalesce(sum(CASE WHEN y = 1 THEN x ELSE 0 END) OVER o, 0) AS c1
       FROM po WINDOW o AS (PARTITION BY feature ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ad AS (SELECT window_id, any_value(y) AS y, sum(CASE WHEN kn.y = 0 THEN x ELSE 0 END) AS p0, sum(CASE WHEN kn.y = 1 THEN x ELSE 0 END) AS p1, count(*) FILTER (c0 = 0 AND c1 = 0) AS fresh FROM kn GROUP BY window_id),
st AS (SELECT window_id, y, coalesce(sum(1 - y) OVER o, 0) AS n0, coalesce(sum(y) OVER o, 0) AS n1, coalesce(sum(p0) OVER o, 0) AS t0, coalesce(sum(p1) OVER o, 0) AS t1, coalesce(sum(fresh) OVER o, 0) AS v
       FROM ad WINDOW o AS (ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
"""
PROGRESS_END = """
sc AS (SELECT window_id, y, CASE WHEN n0 > 0 AND n1 > 0 THEN exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))) WHEN n1 > 0 THEN 1 WHEN n0 > 0 THEN 0 ELSE 0.5 END AS score FROM s)
SELECT window_id, y AS label, round(CAST(score AS DOUBLE), 8) AS score FROM sc"""


def progressive(spark, sf_dir, form: str) -> DataFrame:
    members, sequences = message_members(spark, sf_dir)
    rows = OnlineNaiveBayes(form, chunk=500).progressive(phrase_counts(members), sequences)
    return rows.select("window_id", "label", F.round("score", 8).alias("score"))


def online_sql(first: str, second: str, prior: str) -> str:
    """Sums of a form's logarithms for the two classes, and what is added for a class."""
    return f"""WITH {PROGRESS.format(x='x_')}
s AS (SELECT st.window_id, st.y, n0, n1, sum({first}) + {prior.format(0)} AS s0, sum({second}) + {prior.format(1)} AS s1 FROM st JOIN kn USING (window_id) GROUP BY st.window_id, st.y, n0, n1), {PROGRESS_END}"""


L0, L1 = ("kn.x * ln((c{0} + 1.0::DOUBLE) / (t{0} + 1.0::DOUBLE * greatest(v, 1)))".format(c) for c in (0, 1))
PRIOR = "CASE WHEN n{0} > 0 THEN ln(n{0}) ELSE 0 END"


@query(online_sql(L0, L1, PRIOR).replace("x_ AS x", "cnt AS x"))
def online_multinomial_scores(spark, sf_dir):
    return progressive(spark, sf_dir, MULTINOMIAL)


@query(online_sql(f"-({L1})", f"-({L0})", "0 * n{0}").replace("x_ AS x", "cnt AS x"))
def online_complement_scores(spark, sf_dir):
    return progressive(spark, sf_dir, COMPLEMENT)


@query(f"""WITH {PROGRESS.format(x='1')}
voc AS (SELECT feature, min(window_id) AS since FROM po GROUP BY feature),
hist AS (
  SELECT st.window_id, voc.feature, count(po.window_id) FILTER (po.y = 0) AS c0, count(po.window_id) FILTER (po.y = 1) AS c1
  FROM st JOIN voc ON since < st.window_id LEFT JOIN po ON po.feature = voc.feature AND po.window_id < st.window_id GROUP BY ALL),
g AS (SELECT window_id, sum(ln(n0 - c0 + 1.0::DOUBLE)) - any_value(v) * ln(any_value(n0) + 2.0::DOUBLE) AS g0, sum(ln(n1 - c1 + 1.0::DOUBLE)) - any_value(v) * ln(any_value(n1) + 2.0::DOUBLE) AS g1 FROM hist JOIN st USING (window_id) GROUP BY window_id),
own AS (SELECT window_id, sum(ln(c0 + 1.0::DOUBLE) - ln(n0 - c0 + 1.0::DOUBLE)) AS h0, sum(ln(c1 + 1.0::DOUBLE) - ln(n1 - c1 + 1.0::DOUBLE)) AS h1 FROM kn JOIN st USING (window_id) WHERE c0 > 0 OR c1 > 0 GROUP BY window_id),
s AS (SELECT window_id, y, n0, n1, coalesce(g0, 0) + coalesce(h0, 0) + {PRIOR.format(0)} AS s0, coalesce(g1, 0) + coalesce(h1, 0) + {PRIOR.format(1)} AS s1 FROM st LEFT JOIN g USING (window_id) LEFT JOIN own USING (window_id)), {PROGRESS_END}""")
def online_bernoulli_scores(spark, sf_dir):
    return progressive(spark, sf_dir, BERNOULLI)


#: The log with few anomalous lines and no anomalous entities, so that windows of an hour are normal and anomalous.
RARE_LOG = LOG.replace("CASE WHEN event_type = 'error' AND value > 20 THEN 1 ELSE 0 END", "CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END")
TIMED_MEMBERS = time_sql(HOUR, None, """, p AS (SELECT mm.*, row_number() OVER (PARTITION BY window_id ORDER BY ts_ms, line_order) - 1 AS pos FROM mm),
sp AS (SELECT window_id, label, event_count, first_line, last_line, CASE WHEN window_id >= counted - n_test THEN 'test' WHEN window_id < n_train THEN 'train' ELSE 'ignored' END AS split_label FROM s, c),
good AS (SELECT window_id FROM sp WHERE split_label = 'train' AND label = 0)""", RARE_LOG, "0")


def hourly(spark, sf_dir) -> Sequences:
    rows = events_as_log(spark, sf_dir).withColumn("anomalous", F.when(F.col("line_order") % 29 == 0, 1).otherwise(0).cast("long"))
    return TimeWindows(rows, no_labels(rows), 0.34, 0.25, span=HOUR).build()


PAIRS = TIMED_MEMBERS + """,
pairs AS (SELECT window_id, pos, template AS target, lag(template, 2) OVER o || ' ' || lag(template, 1) OVER o AS history FROM p WINDOW o AS (PARTITION BY window_id ORDER BY pos) QUALIFY pos >= 2)"""


@query(PAIRS + " SELECT window_id, pos, target, history FROM pairs")
def next_event_pairs(spark, sf_dir):
    members = hourly(spark, sf_dir).members
    return history_pairs(members, 2).select("window_id", "pos", "target", F.array_join("history", " ").alias("history"))


KEYS = PAIRS + """,
tp AS (SELECT pairs.* FROM pairs JOIN good USING (window_id)),
cn AS (SELECT history, target, count(*) AS n FROM tp GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY history ORDER BY n DESC, target) AS r FROM cn),
ev AS (SELECT pairs.*, r FROM pairs LEFT JOIN rk ON rk.history = pairs.history AND rk.target = pairs.target)"""


def key_events(spark, sf_dir) -> DataFrame:
    """Two templates of history, over windows of an hour."""
    built = hourly(spark, sf_dir)
    return KeyModel(history=2, top=5, shortest=2).fit(built.members, built.sequences).events(built.members)


@query(KEYS + " SELECT count(*) AS eligible, count(*) FILTER (r <= 1) AS hit_1, count(*) FILTER (r <= 2) AS hit_2, count(*) FILTER (r <= 5) AS hit_5 FROM ev")
def next_event_topk(spark, sf_dir):
    events = key_events(spark, sf_dir).select(F.col("target").alias("actual"), "candidates", "history")
    return next_event_metrics(events)["topk"]


@query(KEYS + """, best AS (SELECT pairs.*, rk.target AS predicted FROM pairs LEFT JOIN rk ON rk.history = pairs.history AND r = 1),
truth AS (SELECT target AS template, count(*) AS support, count(*) FILTER (predicted = target) AS tp FROM best GROUP BY target),
guess AS (SELECT predicted AS template, count(*) AS said FROM best WHERE predicted IS NOT NULL GROUP BY predicted)
SELECT template, support, tp, coalesce(said, 0) AS said, round(coalesce(CAST(tp AS DOUBLE) / nullif(said, 0), 0), 8) AS precision, round(CAST(tp AS DOUBLE) / support, 8) AS recall FROM truth LEFT JOIN guess USING (template)""")
def next_event_labels(spark, sf_dir):
    events = key_events(spark, sf_dir).select(F.col("target").alias("actual"), "candidates", "history")
    rows = next_event_metrics(events)["labels"]
    return rows.select("template", "support", "tp", "said", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


GOOD = TIMED_MEMBERS + """,
g2 AS (SELECT p.*, ts_ms - lag(ts_ms) OVER (PARTITION BY window_id ORDER BY pos) AS dt FROM p),
val AS (SELECT window_id, pos, template, 'param_0' AS feature, CAST(cents AS DOUBLE) AS value FROM g2 UNION ALL SELECT window_id, pos, template, 'param_1', key FROM g2 UNION ALL SELECT window_id, pos, template, 'dt_prev_ms', CAST(dt AS DOUBLE) FROM g2 WHERE dt IS NOT NULL),
tv AS (SELECT val.* FROM val JOIN good USING (window_id)),
sch AS (SELECT template, feature, bool_and(value IS NOT NULL) AS kept FROM tv GROUP BY ALL)"""


def training_values(spark, sf_dir) -> DataFrame:
    built = hourly(spark, sf_dir)
    return parameter_values(normal_training(built.members, built.sequences))


@query(GOOD + " SELECT template, feature, kept FROM sch")
def numeric_parameter_schema(spark, sf_dir):
    return parameter_schema(training_values(spark, sf_dir))


@query(GOOD + " SELECT template, feature, round(avg(value), 6) AS mean, round(sqrt(greatest(var_pop(value), 1e-8)), 6) AS std FROM tv JOIN sch USING (template, feature) WHERE kept GROUP BY template, feature")
def parameter_normalisation(spark, sf_dir):
    values = training_values(spark, sf_dir)
    return normalisation(values, parameter_schema(values)).select("template", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


STRAYS = GOOD + """,
se AS (SELECT window_id, pos, template, row_number() OVER (PARTITION BY window_id, template ORDER BY pos) AS i, count(*) OVER (PARTITION BY window_id, template) AS n FROM p JOIN good USING (window_id)),
pf AS (SELECT window_id, pos, template, i > n - least(greatest(ceil((n - 2) * CAST(0.3 AS DOUBLE)), 1), n - 3) AS held FROM se WHERE n - 2 >= 2),
norm AS (SELECT template, feature, avg(value) AS mean, sqrt(greatest(var_pop(value), 1e-8)) AS std FROM tv JOIN pf USING (window_id, pos, template) JOIN sch USING (template, feature) WHERE kept AND NOT held GROUP BY template, feature),
x AS (SELECT window_id, pos, template, feature, (value - mean) / std AS x FROM val JOIN norm USING (template, feature)),
gs AS (SELECT *, avg(x) OVER o AS guess, count(x) OVER o AS seen FROM x WINDOW o AS (PARTITION BY window_id, template, feature ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
res AS (SELECT window_id, pos, template, avg((x - guess) * (x - guess)) AS residual FROM gs WHERE seen = 2 GROUP BY ALL),
bd AS (SELECT template, greatest(avg(residual) - 2.3263478740408408 * sqrt(var_pop(residual)), 0) AS lower, avg(residual) + 2.3263478740408408 * sqrt(var_pop(residual)) AS upper
       FROM res JOIN pf USING (window_id, pos, template) WHERE held GROUP BY template),
stray AS (SELECT window_id, pos, template, residual, residual - upper AS margin, residual > upper AS anomalous FROM res JOIN bd USING (template))"""


@query(STRAYS + " SELECT template, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM norm")
def parameter_prefix_scale(spark, sf_dir):
    """Scales that a parameter model learns, from the prefixes of training."""
    built = hourly(spark, sf_dir)
    scale = ParameterModel().fit(built.members, built.sequences).scale
    return scale.select("template", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(STRAYS + " SELECT template, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bd")
def gaussian_thresholds(spark, sf_dir):
    """Bounds of the residuals in the tail of training."""
    built = hourly(spark, sf_dir)
    return ParameterModel().fit(built.members, built.sequences).bounds.select("template", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(STRAYS + " SELECT window_id, pos, template, round(residual, 6) AS residual, round(margin, 6) AS margin, anomalous FROM stray")
def parameter_anomalies(spark, sf_dir):
    built = hourly(spark, sf_dir)
    events = ParameterModel().fit(built.members, built.sequences).events(built.members)
    return events.select("window_id", "pos", "template", F.round("residual", 6).alias("residual"), F.round("margin", 6).alias("margin"), "anomalous")


JOINT = STRAYS + """,
hs AS (SELECT window_id, pos, template AS target, [lag(template, 4) OVER o, lag(template, 3) OVER o, lag(template, 2) OVER o, lag(template, 1) OVER o] AS history FROM p WINDOW o AS (PARTITION BY window_id ORDER BY pos) QUALIFY pos >= 4),
tried AS (SELECT hs.*, n, list_slice(history, 5 - n, 4) AS ending FROM hs, range(1, 5) r(n)),
cn AS (SELECT ending, target, count(*) AS c FROM tried JOIN good USING (window_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY c DESC, target) AS r, sum(c) OVER (PARTITION BY ending) AS total FROM cn),
vocabulary AS (SELECT DISTINCT template FROM p JOIN good USING (window_id)),
unseen AS (SELECT DISTINCT window_id, pos FROM (SELECT window_id, pos, unnest(history) AS template FROM hs) WHERE template NOT IN (SELECT template FROM vocabulary)),
best AS (SELECT window_id, pos, max(n) AS n FROM tried WHERE ending IN (SELECT ending FROM cn) AND (window_id, pos) NOT IN (SELECT (window_id, pos) FROM unseen) GROUP BY ALL),
ke AS (
  SELECT t.window_id, t.pos, best.n IS NULL OR r IS NULL AS bad, CASE WHEN best.n IS NULL THEN NULL ELSE coalesce(c / total, 0) END AS prob
  FROM hs t LEFT JOIN best USING (window_id, pos) LEFT JOIN rk ON rk.ending = list_slice(t.history, 5 - best.n, 4) AND rk.target = t.target AND r <= 3),
je AS (SELECT ke.*, NOT bad AND coalesce(anomalous, false) AS odd, margin FROM ke LEFT JOIN stray USING (window_id, pos)),
jw AS (SELECT window_id, max(CAST(bad OR odd AS INTEGER)) AS said, max(CASE WHEN bad THEN 1 - coalesce(prob, 0) WHEN odd THEN margin ELSE 0 END) AS signal FROM je GROUP BY window_id)"""


@query(JOINT + " SELECT window_id, label, split_label, coalesce(said, 0) AS predicted_label, round(coalesce(signal, 0), 6) AS score FROM sp LEFT JOIN jw USING (window_id)")
def next_event_predictions(spark, sf_dir):
    """Keys with histories of four templates and parameters where the key passed."""
    built = hourly(spark, sf_dir)
    keys = KeyModel(history=4, top=3, strict=True).fit(built.members, built.sequences)
    out = predict_jointly(keys, ParameterModel().fit(built.members, built.sequences), built.members, built.sequences)
    return out.select("window_id", "label", "split_label", "predicted_label", F.round("score", 6).alias("score"))


CONTEXTS = f"""WITH {ENTITIES}, d AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY window_id ORDER BY pos) AS dt FROM members),
e AS (SELECT *, sum(coalesce(dt, 0)) OVER o AS sm, count(*) FILTER (dt IS NULL) OVER o AS gp FROM d WINDOW o AS (PARTITION BY window_id ORDER BY pos))"""


def lagged(k: int, stale: int | None) -> str:
    test = "true" if stale is None else f"NOT (sm - lag(sm, {k}) OVER o > {stale} AND gp = lag(gp, {k}) OVER o)"
    return f"coalesce(CASE WHEN {test} THEN lag(template, {k}) OVER o END, '<no event>')"


def context_sql(stale: int | None) -> str:
    return CONTEXTS + f" SELECT window_id, pos, template, {lagged(3, stale)} || ' ' || {lagged(2, stale)} || ' ' || {lagged(1, stale)} AS context FROM e WINDOW o AS (PARTITION BY window_id ORDER BY pos)"


def context_rows(spark, sf_dir, timeout: int | None) -> DataFrame:
    built = entities(spark, sf_dir).build()
    return contexts(built.members, built.sequences, 3, timeout).select("window_id", "pos", "template", F.array_join("context", " ").alias("context"))


@query(context_sql(None))
def event_contexts(spark, sf_dir):
    return context_rows(spark, sf_dir, None)


@query(context_sql(4 * HOUR))
def event_contexts_with_timeout(spark, sf_dir):
    return context_rows(spark, sf_dir, 4 * HOUR)


#: Twenty templates: the event's type and what is left of its value.
FINE = ENTITIES.replace("event_type AS template", "event_type || '/' || CAST(CAST(floor(value * 100) AS BIGINT) % 4 AS VARCHAR) AS template")


def fine_entities(spark, sf_dir) -> Sequences:
    rows = events_as_log(spark, sf_dir).withColumn("template", F.concat("template", F.lit("/"), (F.get("params", F.lit(0)).cast("long") % 4).cast("string")))
    return EntitySequences(rows, L.inline_group_labels(rows), 0.3, 0.5).build()


#: Contexts of two of twenty templates, what follows them in training, and all events with their candidates.
NEXT = f"""WITH {FINE},
ca AS (SELECT window_id, pos, template, [coalesce(lag(template, 2) OVER o, '<no event>'), coalesce(lag(template, 1) OVER o, '<no event>')] AS ctx FROM members WINDOW o AS (PARTITION BY window_id ORDER BY pos)),
cc AS (SELECT ca.*, split_label FROM ca JOIN split USING (window_id)),
tt AS (SELECT ctx, template, count(*) AS n FROM cc WHERE split_label = 'train' GROUP BY ctx, template),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY ctx ORDER BY n DESC, template) AS INTEGER) AS rank FROM tt QUALIFY rank <= 5),
vo AS (SELECT DISTINCT template FROM cc WHERE split_label = 'train'),
dg AS (
  SELECT cc.*, tk.rank, CASE WHEN cc.template NOT IN (SELECT template FROM vo) THEN 'target' WHEN len(list_filter(cc.ctx, lambda x: x = '<no event>')) > 0 OR cc.ctx[1] NOT IN (SELECT template FROM vo) OR cc.ctx[2] NOT IN (SELECT template FROM vo) THEN 'history' END AS gap
  FROM cc LEFT JOIN tk ON tk.ctx = cc.ctx AND tk.template = cc.template WHERE split_label = 'test')"""


@query(NEXT + " SELECT array_to_string(ctx, '|') AS context, rank, template, n FROM tk")
def context_top_templates(spark, sf_dir):
    built = fine_entities(spark, sf_dir)
    train = contexts(built.members, built.sequences, 2).where("split_label = 'train'")
    return top_templates(train, 5).select(F.array_join("context", "|").alias("context"), "rank", "template", "n")


def context_diagnostics(spark, sf_dir, policy: str) -> DataFrame:
    """Next-event diagnostics of contexts over test sequences."""
    built = fine_entities(spark, sf_dir)
    rows = kept(contexts(built.members, built.sequences, 2))
    train, test = rows.where("split_label = 'train'"), rows.where("split_label = 'test'")
    found = next_event_metrics(next_candidates(test, top_templates(train, 5)), known=train.select("template"), policy=policy, padding=NO_EVENT)
    counts = found["summary"].select("events", "unknown_target", "unknown_history", F.round("coverage", 8).alias("coverage"))
    return found["topk"].crossJoin(counts)


def diagnostics_sql(train_only: bool) -> str:
    fine, why = ("gap IS NULL", "count(*) FILTER (gap = '{}')") if train_only else ("true", "CAST(0 AS BIGINT)")
    return NEXT + f""" SELECT count(*) FILTER ({fine}) AS eligible, count(*) FILTER ({fine} AND rank <= 1) AS hit_1, count(*) FILTER ({fine} AND rank <= 2) AS hit_2, count(*) FILTER ({fine} AND rank <= 5) AS hit_5,
  count(*) AS events, {why.format('target')} AS unknown_target, {why.format('history')} AS unknown_history, round(count(*) FILTER ({fine}) / count(*), 8) AS coverage FROM dg"""


@query(diagnostics_sql(False))
def context_next_event_full_dataset(spark, sf_dir):
    return context_diagnostics(spark, sf_dir, FULL_DATASET)


@query(diagnostics_sql(True))
def context_next_event_train_only(spark, sf_dir):
    return context_diagnostics(spark, sf_dir, TRAIN_ONLY)


CONTEXT_SCORES = CONTEXTS + f""",
cx AS (SELECT window_id, pos, template, anomalous, [{lagged(3, None)}, {lagged(2, None)}, {lagged(1, None)}] AS ctx FROM e WINDOW o AS (PARTITION BY window_id ORDER BY pos)),
cb AS (SELECT window_id, pos, template, CAST(anomalous <> 0 AS INTEGER) AS truth, array_to_string(list_sort(list_distinct(ctx)), '|') AS bag, split_label FROM cx JOIN split USING (window_id)),
gr AS (SELECT template, bag, count(*) AS n, max(truth) AS worst FROM cb WHERE split_label = 'train' GROUP BY ALL),
ce AS (SELECT cb.*, CASE WHEN cb.template NOT IN (SELECT template FROM gr) THEN -2.0::DOUBLE WHEN n IS NULL THEN -3 WHEN n < 5 THEN -1 ELSE worst END AS score FROM cb LEFT JOIN gr ON gr.template = cb.template AND gr.bag = cb.bag)"""


def context_events(spark, sf_dir) -> DataFrame:
    built = entities(spark, sf_dir).build()
    return ContextModel(3, None, 5).fit(built.members, built.sequences).events(built.members, built.sequences)


@query(CONTEXT_SCORES + " SELECT window_id, pos, score FROM ce")
def context_scores(spark, sf_dir):
    return context_events(spark, sf_dir).select("window_id", "pos", "score")


@query(CONTEXT_SCORES + """ SELECT CASE WHEN score > 0 THEN 'known_malicious_cluster' WHEN score = -1 THEN 'not_confident_enough' WHEN score = -2 THEN 'event_not_in_training_vocabulary' WHEN score = -3 THEN 'closest_cluster_outside_epsilon' ELSE 'known_benign_cluster' END AS reason, count(*) AS n FROM ce GROUP BY reason""")
def context_reasons(spark, sf_dir):
    return context_events(spark, sf_dir).groupBy(reason(F.col("score")).alias("reason")).agg(F.count("*").alias("n"))


@query(CONTEXT_SCORES + """ SELECT count(*) AS events, count(*) FILTER (score < 0) AS abstained, count(*) FILTER (score > 0 AND truth <> 0) AS tp, count(*) FILTER (score > 0 AND truth = 0) AS fp, count(*) FILTER (score = 0 AND truth = 0) AS tn, count(*) FILTER (score = 0 AND truth <> 0) AS fn, round(count(*) FILTER (score >= 0) / count(*), 8) AS coverage FROM ce WHERE split_label = 'test'""")
def context_decisions(spark, sf_dir):
    return decision_summary(context_events(spark, sf_dir).where("split_label = 'test'"))


CLUSTERS = f"""WITH RECURSIVE {FINE},
cx AS (SELECT window_id, pos, template, CAST(anomalous <> 0 AS INTEGER) AS truth, [coalesce(lag(template, 3) OVER o, '<no event>'), coalesce(lag(template, 2) OVER o, '<no event>'), coalesce(lag(template, 1) OVER o, '<no event>')] AS ctx
       FROM members WINDOW o AS (PARTITION BY window_id ORDER BY pos)),
cb AS (SELECT window_id, pos, template, truth, array_to_string(list_sort(ctx), chr(31)) AS bag, ctx, split_label FROM cx JOIN split USING (window_id)),
pt AS (SELECT template, bag, count(*) AS n, max(truth) AS worst, any_value(ctx) AS ctx FROM cb WHERE split_label = 'train' GROUP BY template, bag),
nb AS (
  SELECT a.template, a.bag, b.bag AS other, b.n, CAST(list_sum(list_transform(list_distinct(a.ctx), lambda x: least(len(list_filter(a.ctx, lambda y: y = x)), len(list_filter(b.ctx, lambda y: y = x))))) AS BIGINT) AS common
  FROM pt a JOIN pt b USING (template)),
near AS (SELECT * FROM nb WHERE common >= 2),
core AS (SELECT template, bag FROM near GROUP BY template, bag HAVING sum(n) >= 8),
link AS (SELECT near.template, near.bag, near.other FROM near JOIN core USING (template, bag) JOIN core o ON o.template = near.template AND o.bag = near.other),
reached AS (SELECT template, bag, bag AS other FROM core UNION SELECT r.template, r.bag, link.other FROM reached r JOIN link ON link.template = r.template AND link.bag = r.other),
own AS (SELECT template, bag, min(other) AS cluster FROM reached GROUP BY template, bag),
edge AS (
  SELECT near.template, near.bag, arg_min(other, (-common, other)) AS other FROM near JOIN core c ON c.template = near.template AND c.bag = near.other
  WHERE (near.template, near.bag) NOT IN (SELECT (template, bag) FROM core) GROUP BY near.template, near.bag),
cl AS (SELECT template, bag, cluster, true AS core FROM own UNION ALL SELECT edge.template, edge.bag, own.cluster, false FROM edge JOIN own ON own.template = edge.template AND own.bag = edge.other),
pc AS (SELECT pt.*, cl.cluster, coalesce(cl.core, false) AS core FROM pt LEFT JOIN cl USING (template, bag)),
cs AS (SELECT template, cluster, CAST(max(worst) AS DOUBLE) AS cluster_score, CAST(sum(n) AS BIGINT) AS cluster_events FROM pc WHERE cluster IS NOT NULL GROUP BY template, cluster)"""


def clustered_contexts(spark, sf_dir):
    built = fine_entities(spark, sf_dir)
    return built, ClusteredContexts(3, None, 8, 0.34).fit(built.members, built.sequences)


@query(CLUSTERS + " SELECT template, bag, n, worst, core, cluster, cluster_score, cluster_events FROM pc LEFT JOIN cs USING (template, cluster)")
def context_clusters(spark, sf_dir):
    return clustered_contexts(spark, sf_dir)[1].points.select("template", "bag", "n", "worst", "core", "cluster", "cluster_score", "cluster_events")


@query(CLUSTERS + """,
ab AS (SELECT DISTINCT template, bag, list_sort(ctx) AS ctx FROM cb),
am AS (
  SELECT a.template, a.bag, p.bag AS other, p.cluster, CAST(list_sum(list_transform(list_distinct(a.ctx), lambda x: least(len(list_filter(a.ctx, lambda y: y = x)), len(list_filter(p.ctx, lambda y: y = x))))) AS BIGINT) AS common
  FROM ab a JOIN pc p USING (template)),
nearest AS (SELECT template, bag, arg_min(coalesce(cluster_score, -1), (-common, other)) AS score FROM am LEFT JOIN cs USING (template, cluster) WHERE common >= 2 GROUP BY template, bag)
SELECT window_id, pos, CASE WHEN template NOT IN (SELECT template FROM pt) THEN -2.0::DOUBLE ELSE coalesce(score, -3) END AS score FROM cb LEFT JOIN nearest USING (template, bag)""")
def context_cluster_scores(spark, sf_dir):
    built, model = clustered_contexts(spark, sf_dir)
    return model.events(built.members, built.sequences).select("window_id", "pos", "score")


#: Some lines have too few words, a fraction of seven digits, a thirteenth month, or no time that can be read.
@query("""
WITH lines AS (SELECT *, event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 AS coarse FROM events WHERE event_id % 11 <> 0)
SELECT event_id AS line_order,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN coarse THEN epoch_us(ts) // 1000000 * 1000 ELSE CAST(trunc(CAST(epoch_us(ts) AS DOUBLE) / CAST(1e6 AS DOUBLE) * 1000) AS BIGINT) END AS timestamp_unix_ms,
  'R' || CAST(user_id AS VARCHAR) AS entity_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS anomalous, 'RAS KERNEL INFO ' || event_type || ' seen' AS untemplated_message_text
FROM lines""")
def bgl_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    node = F.concat(F.lit("R"), F.col("user_id").cast("string"))
    tail = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("INFO "), F.col("event_type"), F.lit(" seen")))
    odd = lambda k: F.col("event_id") % k == 0
    fine = F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS")
    fine = F.when(odd(19) | odd(23), F.date_format("ts", "yyyy-'13'-dd-HH.mm.ss.SSSSSS")).when(odd(17), F.concat(fine, F.lit("0"))).otherwise(fine)
    epoch = F.when(odd(23), "9" * 25).otherwise(F.unix_seconds("ts").cast("string"))
    line = F.concat_ws(" ", F.when(F.col("event_id") % 3 == 0, "-").otherwise("APPREAD"), epoch, F.date_format("ts", "yyyy.MM.dd"), node, fine, node, F.lit("RAS KERNEL"), tail)
    rows = parser("bgl").parse(e.select(F.col("event_id").alias("line_order"), line.alias("value")))
    return rows.select("line_order", "timestamp_unix_ms", "entity_id", F.col("anomalous").cast("int").alias("anomalous"), "untemplated_message_text")


@query("""
SELECT event_id AS line_order, epoch_us(date_trunc('second', ts)) // 1000 AS timestamp_unix_ms, CASE WHEN event_id % 2 = 0 THEN 'blk_-' || CAST(user_id AS VARCHAR) ELSE 'dfs.' || event_type END AS entity_id,
  'INFO dfs.' || event_type || ': got ' || CASE WHEN event_id % 2 = 0 THEN 'blk_-' || CAST(user_id AS VARCHAR) ELSE 'nothing' END AS untemplated_message_text FROM events WHERE event_id % 13 <> 0""")
def hdfs_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    content = F.concat(F.lit("got "), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("blk_-"), F.col("user_id").cast("string"))).otherwise("nothing"))
    line = F.concat(F.date_format("ts", "yyMMdd HHmmss"), F.lit(" 143 INFO dfs."), F.col("event_type"), F.lit(": "), content)
    line = F.when(F.col("event_id") % 13 == 0, "no log line").otherwise(line)
    rows = parser("hdfs_v1").parse(e.select(F.col("event_id").alias("line_order"), line.alias("value")))
    return rows.select("line_order", "timestamp_unix_ms", "entity_id", "untemplated_message_text")


@query(f"WITH {LOG} SELECT line_order, regexp_replace(text, '(^| )[0-9]+( |$)', '\\1<:NUM:>\\2', 'g').regexp_replace(' [0-9]+\\}}', ' <:NUM:>}}', 'g') AS masked FROM log")
def masked_messages(spark, sf_dir):
    return events_as_log(spark, sf_dir).select("line_order", masked(F.col("untemplated_message_text")).alias("masked"))


#: How many places of two lists have the same token.
SHARED = "len(list_filter(list_zip({a}, {b}), lambda z: z[1] = z[2]))"
DRAIN = f"""WITH RECURSIVE {LOG},
mk AS (SELECT line_order, regexp_replace(text, '(^| )[0-9]+( |$)', '\\1<:NUM:>\\2', 'g').regexp_replace(' [0-9]+\\}}', ' <:NUM:>}}', 'g') AS masked FROM log),
tk AS (SELECT line_order, list_filter(string_split_regex(replace(masked, '_', ' '), '\\s+'), lambda x: x <> '') AS tokens FROM mk),
ms AS (SELECT tokens, min(line_order) AS first, len(tokens) AS n, CASE WHEN regexp_matches(tokens[1], '[0-9]') THEN '<:*:>' ELSE coalesce(tokens[1], '') END AS lead FROM tk GROUP BY tokens),
nr AS (
  SELECT m.n, m.lead, m.first, list(b.first) FILTER (b.first IS NOT NULL) AS near
  FROM ms m LEFT JOIN ms b ON b.n = m.n AND b.lead = m.lead AND b.first < m.first AND {SHARED.format(a='m.tokens', b='b.tokens')} >= 0.4 * m.n GROUP BY m.n, m.lead, m.first),
sd AS (
  SELECT n, lead, [min(first)] AS seeds FROM nr GROUP BY n, lead
  UNION ALL
  SELECT sd.n, sd.lead, list_append(any_value(sd.seeds), min(nr.first)) FROM sd JOIN nr ON nr.n = sd.n AND nr.lead = sd.lead AND nr.first > list_max(sd.seeds) AND NOT list_has_any(coalesce(nr.near, []), sd.seeds) GROUP BY sd.n, sd.lead),
ss AS (SELECT n, lead, unnest(arg_max(seeds, len(seeds))) AS first FROM sd GROUP BY n, lead),
ow AS (
  SELECT m.n, m.lead, m.tokens, arg_min(ss.first, (-{SHARED.format(a='m.tokens', b='s.tokens')}, ss.first)) AS seed
  FROM ms m JOIN ss ON ss.n = m.n AND ss.lead = m.lead JOIN ms s ON s.n = ss.n AND s.lead = ss.lead AND s.first = ss.first GROUP BY m.n, m.lead, m.tokens),
pl AS (SELECT n, lead, seed, i, CASE WHEN min(tokens[i]) = max(tokens[i]) THEN min(tokens[i]) ELSE '<:*:>' END AS token FROM ow, range(1, n + 1) r(i) GROUP BY n, lead, seed, i),
tp AS (SELECT DISTINCT n, lead, tokens FROM (SELECT n, lead, seed, list(token ORDER BY i) AS tokens FROM pl GROUP BY n, lead, seed)),
ft AS (
  SELECT m.tokens, tp.tokens AS own, array_to_string(tp.tokens, ' ') AS template, len(list_filter(tp.tokens, lambda x: x <> '<:*:>')) AS literals
  FROM ms m JOIN tp ON tp.n = m.n AND tp.lead = m.lead AND len(list_filter(list_zip(m.tokens, tp.tokens), lambda z: z[1] = z[2] OR z[2] = '<:*:>')) = m.n),
bs AS (SELECT tokens, arg_max(own, (literals, template)) AS own, arg_max(template, (literals, template)) AS template FROM ft GROUP BY tokens)
SELECT line_order, template, array_to_string(list_transform(list_filter(list_zip(tk.tokens, own), lambda z: z[2] = '<:*:>'), lambda z: z[1]), ' ') AS params FROM tk LEFT JOIN bs ON bs.tokens = tk.tokens"""


@query(DRAIN)
def drain_templates(spark, sf_dir):
    rows = events_as_log(spark, sf_dir).drop("template", "params")
    return DrainParser().fit(rows).transform(rows).select("line_order", "template", F.array_join("params", " ").alias("params"))


@query(CONTEXT_SCORES + """ SELECT s.window_id, s.label, s.split_label, CAST(max(score) > 0 AS INTEGER) AS predicted_label, NOT max(score) > 0 AND min(score) < 0 AS abstained, greatest(max(score), 0) AS score
FROM split s JOIN ce USING (window_id) GROUP BY s.window_id, s.label, s.split_label""")
def context_predictions(spark, sf_dir):
    built = entities(spark, sf_dir).build()
    out = ContextModel(3, None, 5).fit(built.members, built.sequences).predict(built.members, built.sequences)
    return out.select("window_id", "label", "split_label", "predicted_label", "abstained", "score")


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role FROM conversations)
SELECT conv_id, string_agg(role, ' ' ORDER BY pos) AS roles, count(*) AS n_turns FROM r GROUP BY conv_id""")
def conversation_sequences(spark, sf_dir):
    """Conversations as sequences without times."""
    rows = table(spark, sf_dir, "conversations").select(F.lit(None).cast("long").alias("timestamp_unix_ms"), F.col("conv_id").cast("string").alias("entity_id"), F.col("text").alias("untemplated_message_text"), F.lit(None).cast("long").alias("anomalous"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_order"), F.col("role").alias("template"))
    labels = rows.where(F.lit(False)).select("entity_id", F.col("anomalous").alias("label"))
    built = nested(EntitySequences(rows, labels).build())
    return built.select(F.get("entity_ids", F.lit(0)).cast("long").alias("conv_id"), F.array_join(F.transform("events", lambda e: e["template"]), " ").alias("roles"), F.size("events").cast("long").alias("n_turns"))
