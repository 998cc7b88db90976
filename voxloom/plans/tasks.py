"""Queries over the catalogue of artefacts and tasks: coverage, folds, resume, shards, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import coverage
from voxloom.sources.tables import ARTEFACTS_SQL, artefacts, table

QUERIES: dict = {}
SQL: dict = {}
BASE = "WITH " + ARTEFACTS_SQL
STATES = ("pending", "in_progress", "completed", "failed")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{BASE} SELECT patient FROM art GROUP BY 1 HAVING count(DISTINCT (kind, slot)) = (SELECT count(DISTINCT (kind, slot)) FROM art)")
def complete_coverage_patients(spark, sf_dir):
    return coverage.complete(artefacts(spark, sf_dir), "patient", ["kind", "slot"])


TASKS = "tasks AS (SELECT patient, kind, slot, patient || '_' || kind || '_' || slot AS task_id FROM (SELECT DISTINCT patient FROM art) a, (SELECT DISTINCT kind FROM art) b, (SELECT DISTINCT slot FROM art) c)"


def _grid(spark, sf_dir):
    a = artefacts(spark, sf_dir)
    return coverage.task_grid(a.select("patient").distinct(), a.select("kind").distinct(), a.select("slot").distinct())


@query(f"{BASE}, {TASKS} SELECT task_id, patient, kind, slot FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM art a WHERE a.patient = t.patient AND a.kind = t.kind AND a.slot = t.slot)")
def resume_pending_tasks(spark, sf_dir):
    return coverage.pending(_grid(spark, sf_dir), artefacts(spark, sf_dir), ["patient", "kind", "slot"])


@query(f"{BASE}, {TASKS} SELECT kind, slot, count(*) AS n FROM tasks t WHERE EXISTS (SELECT 1 FROM art a WHERE a.patient = t.patient AND a.kind = t.kind AND a.slot = t.slot) GROUP BY 1, 2")
def tasks_with_inputs(spark, sf_dir):
    return coverage.present(_grid(spark, sf_dir), artefacts(spark, sf_dir), ["patient", "kind", "slot"]).groupBy("kind", "slot").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT patient, kind, min(slot) AS fold FROM art GROUP BY 1, 2")
def first_fold_with_key(spark, sf_dir):
    return coverage.first_fold(artefacts(spark, sf_dir).withColumnRenamed("slot", "fold"), ["patient", "kind"])


@query(f"{BASE} SELECT patient, first(event_id ORDER BY CASE kind WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS path FROM art GROUP BY 1")
def first_match_by_priority(spark, sf_dir):
    a = artefacts(spark, sf_dir).withColumn("priority", F.when(F.col("kind") == "purchase", 0).when(F.col("kind") == "click", 1).otherwise(2)).withColumn("path", F.col("event_id"))
    return coverage.by_priority(a, ["patient"], "path", "priority")


FOLDS = """u AS (SELECT DISTINCT patient FROM art), o AS (SELECT patient, row_number() OVER (ORDER BY md5(patient::VARCHAR), patient) AS p, count(*) OVER () AS n FROM u),
    f AS (SELECT patient, CASE WHEN p <= n // 3 THEN 1 WHEN p <= n // 3 + (n + 1) // 3 THEN 2 ELSE 3 END AS fold FROM o)"""


def _folds(spark, sf_dir):
    units = artefacts(spark, sf_dir).select("patient").distinct()
    return coverage.kfold(units, "patient", 3, F.md5(F.col("patient").cast("string")))


@query(f"{BASE}, {FOLDS} SELECT patient, fold FROM f")
def kfold_assignment(spark, sf_dir):
    return _folds(spark, sf_dir)


@query(f"{BASE}, {FOLDS} SELECT k AS fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM f, generate_series(1, 3) g(k) GROUP BY 1, 2")
def fold_sizes(spark, sf_dir):
    return coverage.manifest(_folds(spark, sf_dir), "patient").groupBy("fold", "split").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 7)::INTEGER AS shard FROM art")
def round_robin_shards(spark, sf_dir):
    return coverage.shards(artefacts(spark, sf_dir).select("event_id"), ["event_id"], 7)


@query(f"""{BASE}, main AS (SELECT patient, kind, min(event_id) AS v FROM art WHERE slot = 0 GROUP BY 1, 2), sh AS (SELECT patient, kind, slot AS shard, min(event_id) AS v FROM art WHERE slot > 0 GROUP BY 1, 2, 3)
    SELECT * FROM main UNION ALL SELECT patient, kind, first(v ORDER BY shard) FROM sh WHERE NOT EXISTS (SELECT 1 FROM main m WHERE m.patient = sh.patient AND m.kind = sh.kind) GROUP BY 1, 2""")
def merge_shards(spark, sf_dir):
    a = artefacts(spark, sf_dir)
    main = a.where("slot = 0").groupBy("patient", "kind").agg(F.min("event_id").alias("v"))
    shards = a.where("slot > 0").groupBy("patient", "kind", F.col("slot").alias("shard")).agg(F.min("event_id").alias("v"))
    return coverage.merge_shards(main, shards, ["patient", "kind"])


STATUS = "CASE payload % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END"


@query(f"{BASE}, s AS (SELECT kind, {STATUS} AS status FROM art) SELECT kind, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATES) + " FROM s GROUP BY 1")
def progress_counts(spark, sf_dir):
    return coverage.progress(artefacts(spark, sf_dir).withColumn("status", F.expr(STATUS)), ["kind"])


@query(f"{BASE}, s AS (SELECT *, {STATUS} AS status FROM art) SELECT patient, kind, status, event_id FROM s QUALIFY row_number() OVER (PARTITION BY patient, kind ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark, sf_dir):
    s = artefacts(spark, sf_dir).withColumn("status", F.expr(STATUS))
    last = s.groupBy("patient", "kind").agg(F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id")).alias("l"))
    return last.select("patient", "kind", "l.status", "l.event_id")


@query(f"{BASE}, a AS (SELECT DISTINCT patient FROM art WHERE kind = 'purchase' AND slot = 0), b AS (SELECT DISTINCT patient FROM art WHERE kind = 'click' AND slot = 0) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def set_operations(spark, sf_dir):
    art = artefacts(spark, sf_dir)
    a, b = (art.where((F.col("kind") == k) & (F.col("slot") == 0)).select("patient").distinct() for k in ("purchase", "click"))
    found = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b), "union_all": a.union(b)}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"{BASE}, c AS (SELECT patient, kind, max(payload) AS v FROM art WHERE slot = 1 GROUP BY 1, 2), f AS (SELECT patient, kind, max(payload) AS v FROM art WHERE slot = 2 GROUP BY 1, 2) SELECT coalesce(f.patient, c.patient) AS patient, coalesce(f.kind, c.kind) AS kind, coalesce(f.v, c.v) AS v FROM f FULL JOIN c ON f.patient = c.patient AND f.kind = c.kind")
def merge_checkpoint_and_file(spark, sf_dir):
    a = artefacts(spark, sf_dir)
    per = lambda s, name: a.where(F.col("slot") == s).groupBy("patient", "kind").agg(F.max("payload").alias(name))
    return per(2, "file").join(per(1, "saved"), ["patient", "kind"], "full").select("patient", "kind", F.coalesce("file", "saved").alias("v"))


@query(f"{BASE}, q AS (SELECT patient, kind, avg(payload) AS qc FROM art WHERE slot = 1 GROUP BY 1, 2), h AS (SELECT patient, kind, avg(payload) AS hr FROM art WHERE slot = 0 GROUP BY 1, 2) SELECT q.patient, q.kind, round(qc, 6) AS qc_score, round(hr, 6) AS hr_qc_score FROM q LEFT JOIN h ON q.patient = h.patient AND q.kind = h.kind")
def qc_against_reference(spark, sf_dir):
    a = artefacts(spark, sf_dir)
    per = lambda s, name: a.where(F.col("slot") == s).groupBy("patient", "kind").agg(F.round(F.avg("payload"), 6).alias(name))
    return per(1, "qc_score").join(per(0, "hr_qc_score"), ["patient", "kind"], "left")


@query("SELECT doc_id, regexp_extract(source, '^src([0-9]+)$', 1) AS number, regexp_replace(source, '[0-9]+$', '') AS stem, try_cast(replace(source, 'src', '') AS INTEGER) AS parsed, source || '|' || lang AS cell, upper(lang) = 'EN' AS english FROM documents")
def parsed_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_extract("source", "^src([0-9]+)$", 1).alias("number"), F.regexp_replace("source", "[0-9]+$", "").alias("stem"), F.expr("try_cast(replace(source, 'src', '') AS int)").alias("parsed"), F.concat_ws("|", "source", "lang").alias("cell"), (F.upper("lang") == "EN").alias("english"))


@query(f"{BASE} SELECT patient, to_json(map_from_entries(list((kind, n) ORDER BY kind))) AS document FROM (SELECT patient, kind, count(*) AS n FROM art GROUP BY 1, 2) GROUP BY 1")
def nested_documents(spark, sf_dir):
    per = artefacts(spark, sf_dir).groupBy("patient", "kind").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("kind", "n")))
    return per.groupBy("patient").agg(F.to_json(F.map_from_entries(entries)).alias("document"))


@query(f"{BASE} SELECT patient, count(*) AS n, s AS spacing FROM art, (VALUES ('3mm'), ('5mm'), ('7mm')) v(s) WHERE kind = 'view' GROUP BY 1, 3")
def replicated_reference(spark, sf_dir):
    """The reference, which has no spacing, next to each spacing's results."""
    return coverage.replicated(artefacts(spark, sf_dir).where("kind = 'view'"), "spacing", ["3mm", "5mm", "7mm"]).groupBy("patient", "spacing").agg(F.count("*").alias("n"))


@query(f"{BASE}, r AS (SELECT patient FROM art WHERE slot IN (0, 1, 2) GROUP BY 1 HAVING count(DISTINCT slot) = 3) SELECT patient FROM r WHERE patient IN (SELECT patient FROM art WHERE kind = 'purchase' AND payload > 50)")
def labelled_and_complete(spark, sf_dir):
    """Patients that have labels and every part of the results."""
    a = artefacts(spark, sf_dir)
    return coverage.covered_units(a.where("slot IN (0, 1, 2)"), a.where("kind = 'purchase' AND payload > 50"), "patient", ["slot"])
