"""Queries of joins, set operations, deduplication, splits and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..operators import dedup, gates, matching, reports, splits
from .tables import BOXES, FRAMES, SAMPLES, SPLIT, box, boxes, frames, read, samples, split_of

Q: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# joins and sets


@query("join_pred_left", f"""WITH {FRAMES}, p AS (SELECT frame, max(event_id) AS event_id FROM frames GROUP BY frame), l AS (SELECT p.frame, e.event_type AS predicted FROM p JOIN events e USING (event_id))
SELECT f.grp, f.frame, f.event_type, l.predicted FROM frames f LEFT JOIN l USING (frame)""")
def join_pred_left(spark, sf_dir):
    e = frames(spark, sf_dir)
    predictions = e.select("frame", F.col("event_type").alias("predicted"), F.col("event_id").alias("line"))
    return matching.prediction_left_join(e.select("grp", "frame", "event_type"), predictions, "frame", "line").select("grp", "frame", "event_type", "predicted")


@query("join_review_map", f"WITH {SAMPLES} SELECT doc_id, quality IS NOT NULL AS reviewed, coalesce(quality = 1 AND n_chars % 2 = 0, false) AS valid FROM samples")
def join_review_map(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("now"))
    reviews = read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("confirmed"), (F.col("now") - F.col("now") % 2).alias("size"))
    both = docs.join(reviews, "doc_id", "left")
    return both.select("doc_id", F.col("confirmed").isNotNull().alias("reviewed"), gates.revision_valid(F.col("confirmed"), F.col("size"), F.lit(0), F.col("now"), F.lit(0)).alias("valid"))


@query("join_confirmed_checked", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'exported' WHEN l.doc_id IS NULL THEN 'unreviewed' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT doc_id + 1000000000, 'unknown key' FROM labels WHERE doc_id % 20 = 0")
def join_confirmed_checked(spark, sf_dir):
    """Reviews of samples that don't exist are named beside what is exported, rejected and not reviewed."""
    l = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("confirmed"))
    strangers = l.where("doc_id % 20 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return matching.confirmed(read(spark, sf_dir, "documents").select("doc_id"), l.unionByName(strangers), "doc_id", "confirmed")


@query("join_confirmed_inner", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN l.quality = 1 THEN 'exported' ELSE 'rejected' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_confirmed_inner(spark, sf_dir):
    d, l = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    confirmed = d.join(l.where("quality = 1"), "doc_id", "left_semi").withColumn("status", F.lit("exported"))
    other = d.join(l.where("quality <> 1"), "doc_id", "left_semi").withColumn("status", F.lit("rejected"))
    return confirmed.unionByName(other).unionByName(d.join(l, "doc_id", "left_anti").withColumn("status", F.lit("unreviewed")))


@query("join_import_by_hash", f"""WITH {SAMPLES}, a AS (SELECT sha, count(*) AS n FROM samples WHERE doc_id % 3 <> 0 GROUP BY sha), b AS (SELECT sha, count(*) AS n FROM samples WHERE doc_id % 5 <> 0 GROUP BY sha)
SELECT coalesce(a.sha, b.sha) AS sha, CASE WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unselected' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.sha = b.sha""")
def join_import_by_hash(spark, sf_dir):
    s = samples(spark, sf_dir).select("doc_id", "sha")
    return matching.import_by_hash(s.where("doc_id % 3 <> 0"), s.where("doc_id % 5 <> 0"), "sha")


@query("join_rebind_reviews", f"""WITH {SAMPLES}, old AS (SELECT 'old/' || doc_id AS label, sha FROM samples WHERE quality IS NOT NULL), new AS (SELECT 'new/' || min(doc_id) AS new_label, sha FROM samples GROUP BY sha)
SELECT label, new_label FROM old JOIN new USING (sha)""")
def join_rebind_reviews(spark, sf_dir):
    s = samples(spark, sf_dir)
    old = s.where("quality is not null").select(F.concat(F.lit("old/"), "doc_id").alias("label"), "sha")
    new = s.groupBy("sha").agg(F.concat(F.lit("new/"), F.min("doc_id")).alias("label"))
    return matching.rebind_reviews(old.select("label"), old, new, "label", "sha").select("label", "new_label")


@query("join_sampling_record", f"""WITH {SAMPLES}, r AS (SELECT doc_id AS record, doc_id * 2 AS path, sha, source FROM samples), p AS (SELECT path, count(*) AS n, min(record) AS record FROM r GROUP BY path), h AS (SELECT sha, source, count(*) AS n, min(record) AS record FROM r GROUP BY sha, source)
SELECT s.doc_id, CASE WHEN p.n IS NOT NULL THEN (CASE WHEN p.n = 1 THEN p.record END) WHEN h.n = 1 THEN h.record END AS record FROM samples s LEFT JOIN p ON p.path = s.doc_id LEFT JOIN h ON h.sha = s.sha AND h.source = s.source""")
def join_sampling_record(spark, sf_dir):
    s = samples(spark, sf_dir).select("doc_id", "sha", "source")
    records = s.select(F.col("doc_id").alias("record"), (F.col("doc_id") * 2).alias("path"), "sha", "source")
    images = s.withColumn("path", F.col("doc_id"))
    return matching.two_stage_match(images, records, "path", ["sha", "source"], "record").select("doc_id", "record")


@query("join_groups_samples", f"WITH {FRAMES} SELECT f.grp, f.frame AS position, f.event_id, f.frame = 0 AS is_start, c.c_mktsegment FROM frames f JOIN customer c ON c.c_custkey = f.grp")
def join_groups_samples(spark, sf_dir):
    groups = frames(spark, sf_dir).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "event_id"))), lambda s: s["event_id"]).alias("members"))
    flat = groups.select("grp", F.posexplode("members").alias("position", "event_id"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grp"), "c_mktsegment")
    return flat.join(c, "grp").select("grp", F.col("position").cast("long").alias("position"), "event_id", (F.col("position") == 0).alias("is_start"), "c_mktsegment")


@query("join_output_parts", "SELECT doc_id, doc_id % 2 = 0 AS has_label, doc_id % 3 = 0 AS has_image, doc_id % 5 <> 1 AS has_overlay, doc_id % 7 <> 0 AS expected, NOT (doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 1 AND doc_id % 7 <> 0) AS delete FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 <> 1")
def join_output_parts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    return matching.output_parts(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), d.where("doc_id % 5 <> 1"), d.where("doc_id % 7 <> 0"), "doc_id")


@query("join_protected_labels", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'equal' END AS status FROM samples")
def join_protected_labels(spark, sf_dir):
    old = samples(spark, sf_dir).select("doc_id", "sha")
    new = old.where("doc_id % 11 <> 0").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("sha")))
    return matching.protected_equal(old, new, "doc_id", "sha")


@query("join_range_window", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey % 3 = 0 AND o.o_orderkey % 3 <> 0 AND abs(date_diff('day', p.o_orderdate, o.o_orderdate)) <= 30)")
def join_range_window(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"))
    return matching.range_window(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), "o_custkey", "day", 30).select("o_orderkey")


#: Patterns of 60 bits; of five that share their first bits the others differ from that of the reference side by 1 to 4 bits.
HASHES = "h AS (SELECT event_id, xor(CAST('0x' || left(sha256(CAST(event_id // 5 AS VARCHAR)), 15) AS BIGINT), (1 << CAST(event_id % 5 AS INTEGER)) - 1) AS v FROM events)"


def _hashes(spark, sf_dir):
    base = F.conv(F.substring(F.sha2(F.floor(F.col("event_id") / 5).cast("string"), 256), 1, 15), 16, 10).cast("long")
    return read(spark, sf_dir, "events").select("event_id", base.bitwiseXOR((F.pow(F.lit(2.0), F.col("event_id") % 5) - 1).cast("long")).alias("v"))


@query("join_hamming_semi", f"WITH {HASHES} SELECT a.event_id FROM h a WHERE a.event_id % 5 <> 0 AND EXISTS (SELECT 1 FROM h b WHERE b.event_id % 5 = 0 AND bit_count(xor(a.v, b.v)) <= 2)")
def join_hamming_semi(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    return matching.hamming_semi(h.where("event_id % 5 <> 0"), h.where("event_id % 5 = 0"), "v", 2).select("event_id")


@query("join_hamming_anti", f"WITH {HASHES} SELECT a.event_id FROM h a WHERE a.event_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.event_id % 5 = 0 AND bit_count(xor(a.v, b.v)) <= 3)")
def join_hamming_anti(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    return matching.hamming_semi(h.where("event_id % 5 <> 0"), h.where("event_id % 5 = 0"), "v", 3, "left_anti").select("event_id")


MANIFESTS = f"{SAMPLES}, b AS (SELECT sha, min(source) AS source, min(doc_id) AS doc_id FROM samples GROUP BY sha), o AS (SELECT sha, source, {SPLIT} AS split FROM b WHERE doc_id < 900), n AS (SELECT sha, CASE WHEN doc_id % 50 = 0 THEN 'src99' ELSE source END AS source, CASE WHEN doc_id % 30 = 1 THEN 'test' ELSE {SPLIT} END AS split FROM b WHERE doc_id >= 50)"


def _manifests(spark, sf_dir):
    b = samples(spark, sf_dir).groupBy("sha").agg(F.min("source").alias("source"), F.min("doc_id").alias("doc_id")).withColumn("split", split_of(F.col("source")))
    n = b.where("doc_id >= 50").withColumn("split", F.when(F.col("doc_id") % 30 == 1, "test").otherwise(F.col("split"))).withColumn("source", F.when(F.col("doc_id") % 50 == 0, "src99").otherwise(F.col("source")))
    return b.where("doc_id < 900"), n


@query("set_diff_manifest", f"WITH {MANIFESTS} SELECT coalesce(o.sha, n.sha) AS sha, CASE WHEN n.sha IS NULL THEN 'missing' WHEN o.sha IS NULL THEN 'new' WHEN o.source <> n.source THEN 'regrouped' WHEN o.split <> n.split THEN 'moved' ELSE 'same' END AS status FROM o FULL JOIN n ON o.sha = n.sha")
def set_diff_manifest(spark, sf_dir):
    return matching.manifest_diff(*_manifests(spark, sf_dir), "sha", "source", "split")


@query("set_diff_strict", f"""WITH {MANIFESTS}, f AS (SELECT coalesce(o.sha, n.sha) AS sha, o.source AS os, n.source AS ns, o.split AS op, n.split AS np FROM o FULL JOIN n ON o.sha = n.sha), c AS (SELECT np AS split, count(*) / (SELECT count(*) FROM n) AS share FROM f WHERE np IS NOT NULL GROUP BY np)
SELECT 'evaluation changed' AS rule, count(*) FILTER (WHERE (op IN ('val', 'test') OR np IN ('val', 'test')) AND op IS DISTINCT FROM np) AS n FROM f UNION ALL SELECT 'regrouped', count(*) FILTER (WHERE os <> ns) FROM f UNION ALL SELECT 'missing', count(*) FILTER (WHERE np IS NULL) FROM f
UNION ALL SELECT 'ratio', count(*) FILTER (WHERE abs(coalesce(share, 0) - ratio) > 0.05) FROM (VALUES ('train', 0.7), ('val', 0.2), ('test', 0.1)) v(split, ratio) LEFT JOIN c USING (split)""")
def set_diff_strict(spark, sf_dir):
    """What strict evaluation forbids of a rebuilt manifest, and splits whose share is off its ratio."""
    return matching.strict_problems(*_manifests(spark, sf_dir), "sha", "source", "split", RATIOS, 0.05)


@query("set_union_dedup_merge", f"""WITH {SAMPLES}, c AS (SELECT sha FROM samples GROUP BY sha HAVING count(*) > 1)
SELECT 'record' AS kind, CAST(doc_id AS VARCHAR) AS value, sha IN (SELECT sha FROM c) AS collides, NULL::BIGINT AS place FROM samples
UNION ALL SELECT 'reference', source, false, row_number() OVER (ORDER BY min(CASE WHEN doc_id < 500 THEN 0 ELSE 1 END), min(doc_id)) FROM samples GROUP BY source""")
def set_union_dedup_merge(spark, sf_dir):
    """The merged manifest with what collides in it, and the references of both in the order in which they first occur."""
    s = samples(spark, sf_dir).select("doc_id", "sha", "source")
    both, first = matching.merged_manifest(s.where("doc_id < 500"), s.where("doc_id >= 500"), ["sha", "doc_id"], "source", ["doc_id"])
    records = both.select(F.lit("record").alias("kind"), F.col("doc_id").cast("string").alias("value"), (F.size("collides") > 0).alias("collides"), F.lit(None).cast("long").alias("place"))
    # one row a reference set
    named = first.select(F.lit("reference").alias("kind"), F.col("source").alias("value"), F.lit(False).alias("collides"), F.row_number().over(W.orderBy("place")).cast("long").alias("place"))
    return records.unionByName(named)

@query("set_intersect_lineage", "SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 0 INTERSECT SELECT DISTINCT source FROM documents WHERE doc_id % 11 = 0")
def set_intersect_lineage(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return matching.lineage_overlap(d.where("doc_id % 7 = 0"), d.where("doc_id % 11 = 0"), "source")


@query("set_except_unreviewed", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_except_unreviewed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").subtract(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("set_new_train_groups", "SELECT DISTINCT source FROM documents WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) >= 15")
def set_new_train_groups(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("source").distinct()
    old = s.where(F.regexp_extract("source", r"(\d+)$", 1).cast("int") < 15)
    return s.join(old, "source", "left_anti")


@query("join_gallery", "SELECT page_id, 'raw/' || page_id AS path FROM pages UNION ALL SELECT page_id, 'overlay/' || page_id FROM pages WHERE page_id % 2 = 0")
def join_gallery(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id")
    flat = p.select("page_id", F.explode(F.array(F.concat(F.lit("raw/"), "page_id"), F.concat(F.lit("overlay/"), "page_id"), F.concat(F.lit("raw/"), "page_id"))).alias("path"))
    listing = p.select(F.concat(F.lit("raw/"), "page_id").alias("path")).unionByName(p.where("page_id % 2 = 0").select(F.concat(F.lit("overlay/"), "page_id").alias("path")))
    return flat.distinct().join(listing, "path", "left_semi").select("page_id", "path")


@query("join_score_video", "SELECT o_custkey, o_totalprice, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS file FROM orders GROUP BY o_custkey, o_totalprice")
def join_score_video(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    found = o.groupBy("o_custkey", "o_totalprice").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("file"))
    asked = o.select("o_custkey", "o_totalprice").distinct()
    return asked.join(found, ["o_custkey", "o_totalprice"]).select("o_custkey", "o_totalprice", F.when(F.col("n") == 1, F.col("file")).alias("file"))


@query("prj_resolve_image", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'own/' || doc_id WHEN doc_id % 3 = 0 THEN 'source/' || doc_id END AS path FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0")
def prj_resolve_image(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    own, source = F.concat(F.lit("own/"), "doc_id"), F.concat(F.lit("source/"), "doc_id")
    listing = d.where("doc_id % 4 = 0").select(own.alias("path")).unionByName(d.where("doc_id % 3 = 0").select(source.alias("path")))
    return matching.first_by_priority(d, "doc_id", [own, source], listing, "path")


@query("src_yolo_pairs", """WITH f AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'h' || page_id % 7 || '/p.' || page_id AS stem FROM pages)
SELECT split, stem, 'ds/images/' || split || '/' || stem || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS image, 'ds/labels/' || split || '/' || stem || '.txt' AS label FROM f WHERE page_id % 3 <> 0 AND page_id % 11 <> 0""")
def src_yolo_pairs(spark, sf_dir):
    """Images and labels of two trees by split and relative stem; a third of the labels is missing, some lie in another split."""
    p = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("h"), F.col("page_id") % 7, F.lit("/p."), "page_id").alias("stem"))
    images = p.select(F.concat(F.lit("ds/images/"), "split", F.lit("/"), "stem", F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise(".png")).alias("path"))
    labels = p.where("page_id % 3 <> 0").select(F.concat(F.lit("ds/labels/"), F.when(F.col("page_id") % 11 == 0, "test").otherwise(F.col("split")), F.lit("/"), "stem", F.lit(".txt")).alias("path"))
    return matching.stem_pairs(images, labels, "ds/images", "ds/labels")

# deduplication and splits


@query("dd_latest_wins", f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY n_chars DESC, doc_id DESC) AS n FROM samples) SELECT sha, doc_id FROM r WHERE n = 1")
def dd_latest_wins(spark, sf_dir):
    return dedup.latest_wins(samples(spark, sf_dir).select("sha", "n_chars", "doc_id"), "sha", ["n_chars", "doc_id"]).select("sha", "doc_id")


@query("dd_latest_reasons", f"""WITH {SAMPLES}, k AS (SELECT sha, doc_id, doc_id * 7919 % 1009 AS stamp FROM samples), b AS (SELECT *, max(stamp * 1000000 + doc_id) OVER (PARTITION BY sha ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
l AS (SELECT *, before IS NULL OR stamp * 1000000 + doc_id > before AS leads FROM b), n AS (SELECT *, min(CASE WHEN leads THEN doc_id END) OVER (PARTITION BY sha ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l)
SELECT doc_id, CASE WHEN NOT leads THEN 'superseded' WHEN nxt IS NOT NULL THEN 'replaced' ELSE 'kept' END AS fate, CASE WHEN NOT leads THEN before % 1000000 ELSE nxt END AS by FROM n""")
def dd_latest_reasons(spark, sf_dir):
    s = samples(spark, sf_dir).select("sha", "doc_id", (F.col("doc_id") * 7919 % 1009).alias("stamp"))
    return dedup.latest_reasons(s, "sha", ["stamp"], "doc_id").select("doc_id", "fate", "by")


@query("dd_bulk_rebind", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN l.doc_id IS NULL THEN 'add' WHEN l.quality <> 1 THEN 'rewrite' ELSE 'keep' END AS action FROM labels l FULL JOIN (SELECT * FROM documents WHERE doc_id % 9 <> 0) d ON l.doc_id = d.doc_id")
def dd_bulk_rebind(spark, sf_dir):
    reviews = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(2).alias("revision"))
    listing = read(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select("doc_id", F.lit(1).alias("revision"))
    return dedup.bulk_rebind(reviews, listing, "doc_id", ["revision"])


@query("dd_hash_cache", f"WITH {SAMPLES} SELECT doc_id, sha AS digest, doc_id % 2 = 0 AS reused FROM samples")
def dd_hash_cache(spark, sf_dir):
    s = samples(spark, sf_dir).select("doc_id", "text", "n_chars", "sha")
    cache = s.where("doc_id % 2 = 0").select("doc_id", "n_chars", F.col("sha").alias("digest")).unionByName(s.where("doc_id % 2 = 1").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit("stale").alias("digest")))
    return dedup.cached_digests(s.drop("sha"), cache, F.col("text"), ["doc_id", "n_chars"]).select("doc_id", "digest", "reused")


FEATURES = f"{SAMPLES}, g AS (SELECT source, count(*) AS samples, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM samples GROUP BY source)"


def _features(spark, sf_dir):
    return splits.group_features(samples(spark, sf_dir), "source", {"en": F.col("lang") == "en", "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query("sp_group_features", f"WITH {FEATURES} SELECT * FROM g")
def sp_group_features(spark, sf_dir):
    return _features(spark, sf_dir)


RATIOS = {"train": 0.7, "val": 0.2, "test": 0.1}


@query("sp_assignment_score", f"""WITH {FEATURES}, l AS (UNPIVOT g ON samples, en, good, toxic INTO NAME feature VALUE n), t AS (SELECT feature, sum(n) AS total, count(*) FILTER (WHERE n > 0) AS k FROM l GROUP BY feature),
a AS (SELECT feature, {SPLIT} AS split, sum(n) AS n FROM l GROUP BY ALL), s AS (SELECT * FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.2::DOUBLE), ('test', 0.1::DOUBLE)) v(split, ratio)),
c AS (SELECT t.feature, s.split, coalesce(a.n, 0) AS n, total * ratio AS target, k FROM t CROSS JOIN s LEFT JOIN a ON a.feature = t.feature AND a.split = s.split)
SELECT 0 AS attempt, round_even(sum(CASE WHEN feature = 'samples' THEN 8.0 ELSE 1.0 END * pow(n - target, 2) / greatest(1.0, target) + CASE WHEN feature <> 'samples' AND k >= 3 AND n = 0 THEN 100 ELSE 0 END), 4) AS score FROM c""")
def sp_assignment_score(spark, sf_dir):
    wide = _features(spark, sf_dir)
    assigned = wide.select(F.lit(0).alias("attempt"), "source", split_of(F.col("source")).alias("split"))
    scored = splits.assignment_scores(splits.long_features(wide, "source"), assigned, RATIOS, "source")
    return scored.select("attempt", F.bround("score", 4).alias("score"))


@query("sp_random_search", f"""WITH {FEATURES}, l AS (UNPIVOT g ON samples, en, good, toxic INTO NAME feature VALUE n), t AS (SELECT feature, sum(n) AS total, count(*) FILTER (WHERE n > 0) AS k FROM l GROUP BY feature),
u AS (SELECT attempt, source, CAST('0x' || left(md5('7:' || attempt || ':' || source), 13) AS BIGINT) / pow(2, 52) AS u FROM (SELECT DISTINCT source FROM g) CROSS JOIN (SELECT unnest(range(6000)) AS attempt)),
d AS (SELECT attempt, source, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM u), a AS (SELECT attempt, string_agg(split, ',' ORDER BY source) AS names FROM d GROUP BY attempt HAVING count(DISTINCT split) = 3),
s AS (SELECT * FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.2::DOUBLE), ('test', 0.1::DOUBLE)) v(split, ratio)), filled AS (SELECT attempt, split, feature, sum(n) AS n FROM d JOIN l USING (source) GROUP BY ALL),
c AS (SELECT a.attempt, names, t.feature, coalesce(f.n, 0) AS n, total * ratio AS target, k FROM a CROSS JOIN t CROSS JOIN s LEFT JOIN filled f ON f.attempt = a.attempt AND f.split = s.split AND f.feature = t.feature),
best AS (SELECT attempt FROM c GROUP BY attempt, names ORDER BY round_even(sum(CASE WHEN feature = 'samples' THEN 8.0 ELSE 1.0 END * pow(n - target, 2) / greatest(1.0, target) + CASE WHEN feature <> 'samples' AND k >= 3 AND n = 0 THEN 100 ELSE 0 END), 6), names, attempt LIMIT 1)
SELECT source, split FROM d JOIN best USING (attempt)""")
def sp_random_search(spark, sf_dir):
    return splits.random_search(splits.long_features(_features(spark, sf_dir), "source"), "source", RATIOS, seed=7)

@query("sp_quotas", """WITH g AS (SELECT user_id, count(DISTINCT event_type) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id), s AS (SELECT user_id, n + days AS n FROM g WHERE n + days >= 3),
q AS (SELECT *, greatest(1, CAST(round_even(n * 0.45::DOUBLE, 0) AS BIGINT)) AS v, greatest(1, CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT)) AS t FROM s), o AS (SELECT *, greatest(0, v + t - n + 1) AS more FROM q)
SELECT user_id, n - v - t + more AS train, v - CASE WHEN v >= t THEN more ELSE 0 END AS val, t - CASE WHEN v >= t THEN 0 ELSE more END AS test FROM o""")
def sp_quotas(spark, sf_dir):
    """Quotas of users as if the kinds and days of their events were groups."""
    g = read(spark, sf_dir, "events").groupBy("user_id").agg((F.count_distinct("event_type") + F.count_distinct(F.to_date("ts"))).alias("n")).where("n >= 3")
    return splits.split_quotas(g, "n", 0.45, 0.5).select("user_id", "train", "val", "test")


@query("sp_frozen", f"SELECT source, CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) < 15 THEN {SPLIT} ELSE 'train' END AS split FROM (SELECT DISTINCT source FROM documents)")
def sp_frozen(spark, sf_dir):
    groups = read(spark, sf_dir, "documents").select("source").distinct()
    before = groups.where(F.regexp_extract("source", r"(\d+)$", 1).cast("int") < 15).withColumn("split", split_of(F.col("source")))
    return splits.frozen(groups, before, "source")


@query("sp_incremental_plan", """WITH g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM documents GROUP BY source), new AS (SELECT source, n, i - (k - 4) AS i FROM g WHERE i >= k - 4),
t AS (SELECT choice, source, n, i, choice // CAST(pow(3, 3 - i) AS BIGINT) % 3 AS s FROM new CROSS JOIN (SELECT unnest(range(81)) AS choice)),
b AS (SELECT choice, x.s, coalesce(f.n, 0) + coalesce((SELECT sum(t.n) FROM t WHERE t.choice = y.choice AND t.s = x.s), 0) AS n FROM (SELECT unnest(range(81)) AS choice) y CROSS JOIN (SELECT unnest(range(3)) AS s) x LEFT JOIN (SELECT i % 3 AS s, sum(n) AS n FROM g WHERE i < k - 4 GROUP BY 1) f ON f.s = x.s),
best AS (SELECT choice FROM b GROUP BY choice ORDER BY round_even(sum(pow(n / (SELECT sum(n) FROM g) - [0.7::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE][s + 1], 2)), 12), choice LIMIT 1)
SELECT source, ['train', 'val', 'test'][s + 1] AS split FROM t JOIN best USING (choice)""")
def sp_incremental_plan(spark, sf_dir):
    """The last four sources are new; those before them keep the splits they have."""
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    numbered = d.withColumn("_i", F.row_number().over(W.orderBy("source")) - 1).withColumn("_k", F.count(F.lit(1)).over(W.partitionBy()))
    old = numbered.where("_i < _k - 4").select("source", F.element_at(F.array(*map(F.lit, splits.SPLITS)), (F.col("_i") % 3 + 1).cast("int")).alias("split"), "n")
    return splits.incremental_plan(old, numbered.where("_i >= _k - 4").select("source", "n"), "source", RATIOS)


@query("sp_oversample_minority", f"""WITH {SAMPLES}, t AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM samples WHERE quality IS NOT NULL), m AS (SELECT max(n) AS most FROM t)
SELECT doc_id, quality, CAST(k AS INTEGER) AS copy FROM t, m, range(0, 2000) r(k) WHERE k * n + i < most""")
def sp_oversample_minority(spark, sf_dir):
    return splits.oversample(samples(spark, sf_dir).where("quality is not null").select("doc_id", "quality"), "quality", "doc_id")


@query("sp_neg_weight", f"WITH {SAMPLES} SELECT doc_id, CASE WHEN coalesce(quality, 0) = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM samples")
def sp_neg_weight(spark, sf_dir):
    return samples(spark, sf_dir).select("doc_id", splits.negative_weight(F.coalesce("quality", F.lit(0)) == 0, 0.25).alias("weight"))


@query("sp_weighted_draw", f"""WITH {SAMPLES}, w AS (SELECT doc_id, CASE WHEN coalesce(quality, 0) = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS weight FROM samples), e AS (SELECT doc_id, weight * (count(*) OVER ()) / sum(weight) OVER () AS share FROM w)
SELECT doc_id, CAST(floor(share) AS BIGINT) AS least, CAST(ceil(share) AS BIGINT) AS most, true AS fair, (SELECT count(*) FROM samples) AS draws FROM e""")
def sp_weighted_draw(spark, sf_dir):
    """As many rows as there are, drawn with replacement by weight: each as often as its share says, to one draw."""
    s = samples(spark, sf_dir).select("doc_id", splits.negative_weight(F.coalesce("quality", F.lit(0)) == 0, 0.25).alias("weight"))
    drawn = splits.weighted_draw(s, "doc_id", "weight", seed=3)
    whole = s.agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_w")).first()
    share = F.col("weight") * whole["_n"] / whole["_w"]
    draws = drawn.agg(F.sum("times")).first()[0]
    both = s.join(drawn, "doc_id", "left").select("doc_id", F.floor(share).alias("least"), F.ceil(share).alias("most"), F.coalesce("times", F.lit(0)).alias("times"))
    return both.select("doc_id", "least", "most", F.col("times").between(F.col("least"), F.col("most")).alias("fair"), F.lit(draws).cast("long").alias("draws"))

@query("sp_frames_per_source", "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source, CAST(115 // n + CASE WHEN i < 115 % n THEN 1 ELSE 0 END AS INTEGER) AS frames FROM s")
def sp_frames_per_source(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("source").distinct()
    n = s.count()
    numbered = s.withColumn("i", F.row_number().over(W.orderBy("source")) - 1)
    return splits.frames_per_source(numbered, F.col("i"), 115, n).select("source", "frames")


# aggregates


@query("agg_split_counts", f"""WITH {SAMPLES}, r AS (SELECT *, {SPLIT} AS split FROM samples) SELECT split, source, lang, count(*) AS n, count(*) FILTER (WHERE quality IS NOT NULL) AS reviewed, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE n_chars >= 1000) AS long, CAST(sum(n_chars) AS BIGINT) AS chars
FROM r GROUP BY GROUPING SETS ((split), (source), (lang), (split, lang), ())""")
def agg_split_counts(spark, sf_dir):
    """Counts by split, by source, by language, by split and the language found there, and over all, in one pass."""
    rows = samples(spark, sf_dir).withColumn("split", split_of(F.col("source")))
    return reports.conditional_counts(rows, [["split"], ["source"], ["lang"], ["split", "lang"], []], {"reviewed": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1, "long": F.col("n_chars") >= 1000}, {"chars": F.col("n_chars")})


@query("agg_source_inventory", f"""WITH {SAMPLES}, l AS (SELECT '/' || lang || '/' || source || '/labels/' || doc_id AS label, quality FROM samples), r AS (SELECT DISTINCT '/' || lang AS root FROM documents UNION SELECT DISTINCT '/' || lang || '/' || source FROM documents WHERE doc_id % 2 = 0),
f AS (SELECT label, quality, min(root) AS root FROM l JOIN r ON starts_with(label, root || '/') GROUP BY ALL) SELECT r.root, (SELECT count(*) FROM l WHERE starts_with(label, r.root || '/')) AS discovered, count(f.label) FILTER (WHERE quality IS NOT NULL) AS included, count(f.label) FILTER (WHERE quality IS NULL) AS excluded FROM r LEFT JOIN f USING (root) GROUP BY r.root""")
def agg_source_inventory(spark, sf_dir):
    """Roots, some of them within others: a label counts as found for each root that contains it, and as in or out for the first."""
    s = samples(spark, sf_dir)
    folder = F.concat(F.lit("/"), "lang", F.lit("/"), "source")
    roots = s.select(F.concat(F.lit("/"), "lang").alias("root")).unionByName(s.where("doc_id % 2 = 0").select(folder.alias("root"))).distinct()
    labels = s.select(F.concat(folder, F.lit("/labels/"), "doc_id").alias("label"), F.col("quality").isNotNull().alias("included"))
    return reports.source_inventory(roots, labels, "root", "label", "included")


PRF = """round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round_even(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1"""


@query("agg_presence_prf", f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 20) AS tp, count(*) FILTER (WHERE event_type <> 'purchase' AND value > 20) AS fp, count(*) FILTER (WHERE event_type = 'purchase' AND value <= 20) AS fn, count(*) FILTER (WHERE event_type <> 'purchase' AND value <= 20) AS tn FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT *, {PRF} FROM c""")
def agg_presence_prf(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_type") != "error", F.col("event_type") == "purchase"))
    return reports.presence(e, F.col("t"), F.col("value") > 20, "user_id")


#: Boxes as the pixels of a line a frame, with the largest score and any target within one pixel; then the metrics of a report.
PIXELS = f"{BOXES}, px AS (SELECT frame, conf, cls = 1 AS t, greatest(coalesce(lag(conf) OVER w, conf), conf, coalesce(lead(conf) OVER w, conf)) AS nc, cls = 1 OR coalesce(lag(cls) OVER w = 1, false) OR coalesce(lead(cls) OVER w = 1, false) AS nt FROM boxes WHERE frame % 5 <> 0 OR cls = 0 WINDOW w AS (PARTITION BY frame ORDER BY det))"
REPORT = """im AS (SELECT frame, bool_or(t) AS t, max(conf) AS conf FROM px GROUP BY frame), pc AS (SELECT i, threshold, count(*) FILTER (WHERE conf >= threshold AND t) AS tp, count(*) FILTER (WHERE conf >= threshold AND NOT t) AS fp, count(*) FILTER (WHERE t) AS targets, count(*) FILTER (WHERE conf >= threshold AND nt) AS tolp, count(*) FILTER (WHERE nc >= threshold AND t) AS tolt FROM lim, px GROUP BY ALL),
ic AS (SELECT i, count(*) FILTER (WHERE conf >= threshold AND t) AS itp, count(*) FILTER (WHERE conf >= threshold AND NOT t) AS ifp, count(*) FILTER (WHERE t) AS pos, count(*) FILTER (WHERE NOT t) AS neg FROM lim, im GROUP BY ALL), nc AS (SELECT i, count(*) FILTER (WHERE px.conf >= threshold) AS npx FROM lim, px JOIN im USING (frame) WHERE NOT im.t GROUP BY ALL),
q AS (SELECT *, coalesce(tolp / nullif(tp + fp, 0), 0) AS tpr, coalesce(tolt / nullif(targets, 0), 0) AS trc, coalesce(itp / nullif(itp + ifp, 0), 0) AS ipr, coalesce(itp / nullif(pos, 0), 0) AS irc FROM pc JOIN ic USING (i) LEFT JOIN nc USING (i)),
report AS (SELECT i, round_even(threshold, 4) AS threshold, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round_even(coalesce(tp / nullif(targets, 0), 0), 6) AS recall, round_even(coalesce(tp / nullif(targets + fp, 0), 0), 6) AS iou, round_even(coalesce(2 * tp / nullif(targets + tp + fp, 0), 0), 6) AS dice,
  round_even(tpr, 6) AS tolerant_precision, round_even(trc, 6) AS tolerant_recall, round_even(coalesce(2 * tpr * trc / nullif(tpr + trc, 0), 0), 6) AS tolerant_f1, round_even(ipr, 6) AS image_precision, round_even(irc, 6) AS image_recall, round_even(coalesce(2 * ipr * irc / nullif(ipr + irc, 0), 0), 6) AS image_f1, round_even(coalesce(coalesce(npx, 0) / nullif(neg, 0), 0), 3) AS negative_pixels FROM q)"""


def _report(spark, sf_dir, thresholds):
    w = W.partitionBy("frame").orderBy("det")
    b = boxes(spark, sf_dir).where("frame % 5 <> 0 or cls = 0").withColumn("t", F.col("cls") == 1)
    beside = lambda c: F.greatest(F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c)))
    px = b.withColumn("nc", beside("conf")).withColumn("nt", beside("t"))
    return reports.threshold_report(px, "frame", F.col("conf"), F.col("t"), F.col("nc"), F.col("nt"), thresholds)


@query("agg_pixel_report", f"WITH {PIXELS}, lim AS (SELECT 0 AS i, CAST(0.5 AS DOUBLE) AS threshold), {REPORT} SELECT * EXCLUDE (i) FROM report")
def agg_pixel_report(spark, sf_dir):
    return _report(spark, sf_dir, [0.5]).drop("i")


@query("agg_pixel_prf", f"""WITH {BOXES}, i AS (SELECT frame, sum(floor(x1)) AS tp, sum(floor(y1)) AS fp, sum(cls) AS fn FROM boxes GROUP BY frame), s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM i)
SELECT round_even(tp / (tp + fp + fn), 6) AS iou, round_even(2 * tp / (2 * tp + fp + fn), 6) AS dice FROM s""")
def agg_pixel_prf(spark, sf_dir):
    s = boxes(spark, sf_dir).agg(F.sum(F.floor("x1")).alias("tp"), F.sum(F.floor("y1")).alias("fp"), F.sum("cls").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(F.bround(reports.ratio(tp, tp + fp + fn), 6).alias("iou"), F.bround(reports.ratio(2 * tp, 2 * tp + fp + fn), 6).alias("dice"))


@query("agg_threshold_select", f"""WITH {PIXELS}, lim AS (SELECT i, CAST(0.15 AS DOUBLE) + i * CAST(0.845 AS DOUBLE) / 34 AS threshold FROM range(35) r(i)), {REPORT}
SELECT * EXCLUDE (i) FROM report ORDER BY coalesce(2 * tolerant_f1 * image_f1 / nullif(tolerant_f1 + image_f1, 0), 0) DESC, image_f1 DESC, negative_pixels, tolerant_f1 DESC, dice DESC, abs(threshold - 0.5), i LIMIT 1""")
def agg_threshold_select(spark, sf_dir):
    """35 thresholds between 0.15 and 0.995, the best by the whole key of a report."""
    return reports.select_threshold(_report(spark, sf_dir, [0.15 + i * 0.845 / 34 for i in range(35)])).drop("i")


@query("agg_threshold_f1", """WITH t AS (SELECT i, 0.15 + i * 0.0245 AS threshold FROM range(35) r(i)), c AS (SELECT i, threshold, count(*) FILTER (WHERE event_type = 'purchase' AND value / 100 >= threshold) AS tp, count(*) FILTER (WHERE event_type <> 'purchase' AND value / 100 >= threshold) AS fp, count(*) FILTER (WHERE event_type = 'purchase' AND value / 100 < threshold) AS fn FROM t, events GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS f1 FROM c)
SELECT round_even(threshold, 6) AS threshold, round_even(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, fp, abs(f.threshold - 0.5), i LIMIT 1""")
def agg_threshold_f1(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    table = reports.threshold_table(e, F.col("value") / 100, F.col("event_type") == "purchase", [0.15 + i * 0.0245 for i in range(35)])
    return reports.best_threshold(table).select(F.bround("threshold", 6).alias("threshold"), F.bround("f1", 6).alias("f1"))


CONF = f"{FRAMES}, k AS (SELECT event_type AS target, coalesce(lag(event_type) OVER (PARTITION BY grp ORDER BY frame), 'unknown') AS predicted FROM frames)"


def _confusion(spark, sf_dir):
    p = frames(spark, sf_dir).withColumn("pred", F.lag("event_type").over(W.partitionBy("grp").orderBy("frame")))
    return reports.confusion(p, "event_type", "pred")


@query("agg_confusion", f"WITH {CONF} SELECT target, predicted, count(*) AS n FROM k GROUP BY ALL")
def agg_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query("agg_confusion_recall", f"WITH {CONF} SELECT target, count(*) AS support, round_even(count(*) FILTER (WHERE target = predicted) / count(*), 6) AS recall FROM k GROUP BY target")
def agg_confusion_recall(spark, sf_dir):
    return reports.recalls(_confusion(spark, sf_dir))


@query("agg_localization", f"""WITH {BOXES}, p AS (SELECT a.*, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2 FROM boxes a JOIN boxes b ON a.frame = b.frame AND b.det = a.det + 1),
i AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS w FROM p), m AS (SELECT w / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - w) AS iou, sqrt(pow((x1 + x2) / 2 - (u1 + u2) / 2, 2) + pow((y1 + y2) / 2 - (v1 + v2) / 2, 2)) AS e FROM i)
SELECT round_even(avg(iou), 6) AS mean_iou, round_even(quantile_cont(iou, 0.5), 6) AS median_iou, round_even(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate_50, round_even(avg(e), 4) AS mean_error, round_even(quantile_cont(e, 0.95), 4) AS p95_error FROM m""")
def agg_localization(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("a", box()).withColumn("b", F.lead("a").over(W.partitionBy("frame").orderBy("det"))).where("b is not null")
    m = b.select(G.bbox_iou(F.col("a"), F.col("b")).alias("iou"), G.distance(G.bbox_center(F.col("a")), G.bbox_center(F.col("b"))).alias("e"))
    r = reports.localisation(m, F.col("iou"), F.col("e"))
    return r.select(*[F.bround(c, 6 if "error" not in c else 4).alias(c) for c in r.columns])


@query("agg_centerline_macro")
def agg_centerline_macro(spark, sf_dir):
    """Means over frames, which count alike, of the distances that are known."""
    from .rows import polylines

    moved = F.transform("line", lambda p: F.array(p[0] + 3, p[1]))
    m = polylines(spark, sf_dir).select(G.centerline_metrics(F.array("line"), F.array(moved)).alias("m")).select("m.*")
    return reports.centerline_macro(m)


@query("agg_centerline_pool")
def agg_centerline_pool(spark, sf_dir):
    from .rows import polylines

    moved = F.transform("line", lambda p: F.array(p[0] + 3, p[1]))
    m = polylines(spark, sf_dir).select(G.centerline_metrics(F.array("line"), F.array(moved)).alias("m")).select("m.*")
    return reports.centerline_pool(m)


@query("agg_method_counts", "SELECT coalesce(CASE WHEN role = 'system' THEN NULL ELSE role END, 'none') AS method, count(*) AS n FROM conversations GROUP BY 1")
def agg_method_counts(spark, sf_dir):
    method = F.coalesce(F.when(F.col("role") != "system", F.col("role")), F.lit("none"))
    return read(spark, sf_dir, "conversations").groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_flag_counts", "SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount > 0.08 THEN 'cheap' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) GROUP BY flag")
def agg_flag_counts(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "large"), F.when(F.col("l_discount") > 0.08, "cheap"), F.when(F.col("l_returnflag") == "R", "returned")))
    return reports.flag_counts(read(spark, sf_dir, "lineitem").select(flags.alias("flags")), "flags")


@query("agg_orientation_summary", f"""WITH {FRAMES}, r AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS raw FROM frames), k AS (SELECT *, lag(event_type) OVER w <> event_type AS moved, lag(raw) OVER w <> raw AS raw_moved FROM r WINDOW w AS (PARTITION BY grp ORDER BY frame)),
c AS (SELECT grp, event_type, count(*) AS n, min(frame) AS first, sum(value) AS s FROM k GROUP BY ALL), m AS (SELECT grp, arg_max({{'l': event_type, 's': s, 'n': n}}, (n, -first)) AS best FROM c GROUP BY grp)
SELECT grp, best.l AS mode, count(*) AS rows, count(*) FILTER (WHERE moved) AS switches, count(*) FILTER (WHERE raw_moved) AS raw_switches, round_even(best.s / best.n, 6) AS mean_confidence FROM k JOIN m USING (grp) GROUP BY grp, best""")
def agg_orientation_summary(spark, sf_dir):
    e = frames(spark, sf_dir).withColumn("raw", F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("event_type")))
    return reports.label_summary(e, "event_type", "raw", "value", "frame", "grp")


@query("agg_orientation_mode", f"""WITH {FRAMES}, c AS (SELECT grp, event_type, count(*) AS n, min(frame) AS first FROM frames GROUP BY ALL) SELECT grp, arg_max(event_type, (n, -first)) AS mode, max(n) AS n, count(*) AS labels FROM c GROUP BY grp""")
def agg_orientation_mode(spark, sf_dir):
    return reports.mode_label(frames(spark, sf_dir), "event_type", "frame", "grp")


@query("agg_collection_audit", f"""WITH {SAMPLES} SELECT 'image in groups' AS kind, sha AS value, count(DISTINCT source) AS n FROM samples GROUP BY sha HAVING count(DISTINCT source) > 1
UNION ALL SELECT 'videos in group', source, count(DISTINCT lang) FROM samples GROUP BY source HAVING count(DISTINCT lang) > 1 UNION ALL SELECT 'video in groups', lang, count(DISTINCT source) FROM samples GROUP BY lang HAVING count(DISTINCT source) > 1""")
def agg_collection_audit(spark, sf_dir):
    return reports.collection_conflicts(samples(spark, sf_dir), "sha", "source", "lang")


@query("agg_current_approvals", "WITH l AS (SELECT conv_id, role, arg_max(length(text) % 2 = 0, turn) AS approves FROM conversations WHERE length(text) % 3 <> 0 GROUP BY conv_id, role) SELECT c.conv_id, count(l.role) FILTER (WHERE approves) AS approvals FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l USING (conv_id) GROUP BY c.conv_id")
def agg_current_approvals(spark, sf_dir):
    n = F.length("text")
    one = F.struct("turn", F.col("role").alias("reviewer"), F.col("role"), F.when(n % 2 == 0, "approve").otherwise("reject").alias("decision"), F.when(n % 3 != 0, "now").otherwise("old").alias("content_digest"))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("reviews"))
    return c.select("conv_id", F.size(gates.current_approvals(F.col("reviews"), F.lit("now"))).cast("long").alias("approvals"))


@query("agg_queue_counts", f"WITH {BOXES} SELECT CASE WHEN conf > 0.8 THEN 'quick_verify' WHEN conf < 0.2 THEN 'hard' ELSE 'standard' END AS queue, count(*) AS n FROM boxes GROUP BY 1")
def agg_queue_counts(spark, sf_dir):
    queue, _ = gates.handoff(F.col("conf") > 0.8, F.col("conf") < 0.2, F.lit(False))
    return boxes(spark, sf_dir).groupBy(queue.alias("queue")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_view_counts", f"WITH {BOXES}, f AS (SELECT frame, count(*) FILTER (WHERE cls = 1) AS n FROM boxes GROUP BY frame) SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS positive, count(*) FILTER (WHERE n = 0) AS negative, CAST(sum(n) AS BIGINT) AS instances FROM f")
def agg_view_counts(spark, sf_dir):
    f = boxes(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("cls") == 1).alias("n"))
    return f.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("positive"), F.count_if(F.col("n") == 0).alias("negative"), F.sum("n").alias("instances"))


@query("agg_registry", """WITH runs AS (SELECT 'run' || c_custkey AS model_id, CASE WHEN c_custkey % 2 = 0 THEN 'detection' ELSE 'string' END AS task, CASE WHEN c_custkey % 5 = 0 THEN 'pool/w' || c_custkey ELSE 'run' || c_custkey || '/weights/best.pt' END AS weights, c_nationkey FROM customer WHERE c_custkey % 7 <> 0),
m AS (SELECT model_id, CASE WHEN CAST(substr(model_id, 4) AS BIGINT) % 3 = 0 THEN model_id || '/current.json' WHEN CAST(substr(model_id, 4) AS BIGINT) % 4 <> 0 THEN model_id || '/test.json' ELSE '' END AS metrics_file FROM runs)
SELECT model_id, task, weights, metrics_file, array_to_string(list_filter([CASE WHEN CAST(substr(model_id, 4) AS BIGINT) % 11 = 0 THEN 'best_weights_missing' END, CASE WHEN c_nationkey = 3 THEN 'dataset_manifest_missing' END, CASE WHEN metrics_file = '' THEN 'independent_test_metrics_missing' END], lambda x: x IS NOT NULL), ',') AS warnings, CASE WHEN weights = 'pool/w10' THEN 'default_detector' ELSE '' END AS roles,
  CAST(substr(model_id, 4) AS BIGINT) % 11 <> 0 AND c_nationkey <> 3 AND metrics_file <> '' AS complete FROM runs JOIN m USING (model_id)
UNION ALL SELECT 'run' || c_custkey, 'unknown', 'run' || c_custkey || '/weights/best.pt', '', 'run_manifest_missing', '', false FROM customer WHERE c_custkey % 7 = 0""")
def agg_registry(spark, sf_dir):
    """Runs with the first metrics file that exists, roles and warnings; weights without a run are listed too."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("run"), "c_custkey").alias("model_id"), "c_custkey", "c_nationkey")
    own = F.concat("model_id", F.lit("/weights/best.pt"))
    runs = c.where("c_custkey % 7 <> 0").select("model_id", F.when(F.col("c_custkey") % 2 == 0, "detection").otherwise("string").alias("task"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("pool/w"), "c_custkey")).alias("weights"), F.concat(F.lit("set"), "c_nationkey").alias("dataset"))
    weights = c.where("c_custkey % 5 <> 0 or c_custkey % 7 = 0").select("model_id", own.alias("path"))
    path = lambda where, p: c.where(where).select(p.alias("path"))
    files = path("c_custkey % 11 <> 0", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("pool/w"), "c_custkey")).otherwise(own)).unionByName(path("c_custkey % 3 = 0", F.concat("model_id", F.lit("/current.json")))).unionByName(path("c_custkey % 4 <> 0", F.concat("model_id", F.lit("/test.json")))).unionByName(path("c_nationkey <> 3", F.concat(F.lit("set"), "c_nationkey")))
    found = reports.registry(runs, files, weights, ("current.json", "test.json"), {"default_detector": "pool/w10"})
    return found.withColumn("warnings", F.array_join("warnings", ",")).withColumn("roles", F.array_join("roles", ","))


@query("agg_run_metrics", """SELECT c.c_custkey AS run, n.n_name AS dataset, coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), max(o_totalprice) FILTER (WHERE o_orderstatus = 'O')) AS metric, CASE WHEN count(o_orderkey) = 0 THEN 'no metrics' ELSE '' END AS warnings
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL""")
def agg_run_metrics(spark, sf_dir):
    c, n, o = (read(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    metrics = o.groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))).alias("metric"), F.lit(True).alias("there"))
    runs = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(metrics, c["c_custkey"] == metrics["o_custkey"], "left")
    warnings = F.array_join(F.array_compact(F.array(F.when(F.col("there").isNull(), "no metrics"))), ",")
    return runs.select(F.col("c_custkey").alias("run"), F.col("n_name").alias("dataset"), "metric", warnings.alias("warnings"))


GATE = f"""{FRAMES}, k AS (SELECT grp, event_type AS target, coalesce(lag(event_type) OVER w, 'none') AS b, CASE WHEN frame % 3 = 0 THEN event_type ELSE coalesce(lag(event_type) OVER w, 'none') END AS c FROM frames WINDOW w AS (PARTITION BY grp ORDER BY frame)), o AS (SELECT f.grp, f.frame, f.target, f.b, f.c, lag(f.b) OVER w AS b0, lag(f.c) OVER w AS c0 FROM (SELECT grp, frame, event_type AS target, coalesce(lag(event_type) OVER v, 'none') AS b, CASE WHEN frame % 3 = 0 THEN event_type ELSE coalesce(lag(event_type) OVER v, 'none') END AS c FROM frames WINDOW v AS (PARTITION BY grp ORDER BY frame)) f WINDOW w AS (PARTITION BY f.grp ORDER BY f.frame))"""


@query("agg_promotion_gate", f"""WITH {GATE}, r AS (SELECT target, avg(CAST(target = b AS INTEGER)) AS rb, avg(CAST(target = c AS INTEGER)) AS rc FROM o GROUP BY target), g AS (SELECT grp, avg(CAST(target = b AS INTEGER)) AS ab, avg(CAST(target = c AS INTEGER)) AS ac FROM o GROUP BY grp),
v AS (SELECT (SELECT avg(CAST(target = c AS INTEGER)) >= avg(CAST(target = b AS INTEGER)) FROM o) AS accuracy, (SELECT avg(rc) >= avg(rb) FROM r) AS macro_recall, (SELECT count(*) FILTER (WHERE c <> c0) <= count(*) FILTER (WHERE b <> b0) FROM o) AS switches, (SELECT bool_and(ac >= ab) FROM g) AS every_group)
SELECT *, accuracy AND macro_recall AND switches AND every_group AS passed FROM v""")
def agg_promotion_gate(spark, sf_dir):
    before = F.coalesce(F.lag("event_type").over(W.partitionBy("grp").orderBy("frame")), F.lit("none"))
    e = frames(spark, sf_dir).withColumn("b", before).withColumn("c", F.when(F.col("frame") % 3 == 0, F.col("event_type")).otherwise(F.col("b")))
    scores = lambda prediction: reports.sequence_scores(e, "event_type", prediction, "grp", "frame")
    return reports.promotion(scores("b"), scores("c"), "grp")


@query("agg_promotion_groups", """WITH g AS (SELECT user_id, count(*) FILTER (WHERE value > 20) AS bh, count(*) FILTER (WHERE event_id % 2 = 0) AS ch FROM events GROUP BY user_id) SELECT bool_and(ch >= bh) AS every_group, sum(ch) >= sum(bh) AS overall, count(*) FILTER (WHERE ch < bh) AS worse_groups FROM g""")
def agg_promotion_groups(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 20).alias("baseline_hits"), F.count_if(F.col("event_id") % 2 == 0).alias("candidate_hits"))
    return reports.promotion_gate(g.withColumn("baseline", F.col("baseline_hits")).withColumn("candidate", F.col("candidate_hits")), "user_id")


@query("agg_digest", f"WITH {SAMPLES} SELECT source, sha256(string_agg(sha, '' ORDER BY doc_id)) AS digest FROM samples GROUP BY source")
def agg_digest(spark, sf_dir):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "sha"))), lambda s: s["sha"]), "")
    return samples(spark, sf_dir).groupBy("source").agg(F.sha2(joined, 256).alias("digest"))


@query("agg_review_totals", f"WITH {SAMPLES} SELECT count(*) AS samples, count(quality) AS reviewed, count(*) FILTER (WHERE toxic = 1) AS errors FROM samples")
def agg_review_totals(spark, sf_dir):
    return samples(spark, sf_dir).agg(F.count(F.lit(1)).alias("samples"), F.count("quality").alias("reviewed"), F.count_if(F.col("toxic") == 1).alias("errors"))


@query("agg_prediction_components", f"WITH {BOXES}, f AS (SELECT frame, count(*) FILTER (WHERE conf > 0.7) AS n FROM boxes GROUP BY frame) SELECT round_even(avg(n), 6) AS mean_components, count(*) FILTER (WHERE n = 0) AS without FROM f")
def agg_prediction_components(spark, sf_dir):
    f = boxes(spark, sf_dir).groupBy("frame").agg(F.count_if(F.col("conf") > 0.7).alias("n"))
    return f.agg(F.bround(F.avg("n"), 6).alias("mean_components"), F.count_if(F.col("n") == 0).alias("without"))


@query("agg_rejections", f"WITH {SAMPLES} SELECT CASE WHEN n_chars < 300 THEN 'provenance' WHEN quality IS NULL THEN 'decode' WHEN toxic = 1 THEN 'hash' ELSE 'kept' END AS reason, count(*) AS n FROM samples GROUP BY 1")
def agg_rejections(spark, sf_dir):
    rules = [("provenance", F.col("n_chars") >= 300), ("decode", F.col("quality").isNotNull()), ("hash", F.col("toxic") == 0)]
    return gates.gate_cascade(samples(spark, sf_dir), rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_reference_inventory", f"""WITH {SAMPLES} SELECT 'provenance' AS kind, sha256(source) AS value, n_chars % 50 AS frame FROM samples WHERE doc_id % 2 = 0
UNION SELECT 'image', sha, NULL FROM samples WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 UNION SELECT 'difference', CAST(CAST('0x' || left(sha, 15) AS BIGINT) AS VARCHAR), NULL FROM samples WHERE doc_id % 3 = 0""")
def agg_reference_inventory(spark, sf_dir):
    s = samples(spark, sf_dir)
    labels = s.where("doc_id % 2 = 0").select(F.col("doc_id").alias("name"), F.upper(F.sha2("source", 256)).alias("video_sha256"), (F.col("n_chars") % 50).alias("frame_index"), F.col("sha").alias("image_sha256"))
    images = s.where("doc_id % 3 = 0").select(F.col("doc_id").alias("name"), F.col("sha").alias("sha256"), F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("bits"))
    return reports.reference_inventory(labels, images)

@query("agg_run_eval", "SELECT c_mktsegment AS run, round_even(avg(c_acctbal), 2) AS metric, CASE WHEN avg(c_acctbal) > 4500 THEN 'eligible' ELSE 'held' END AS status FROM customer GROUP BY c_mktsegment")
def agg_run_eval(spark, sf_dir):
    r = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run")).agg(F.avg("c_acctbal").alias("m"))
    return r.select("run", F.bround("m", 2).alias("metric"), F.when(F.col("m") > 4500, "eligible").otherwise("held").alias("status"))
