"""Queries over splits, joins, the registry and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import clusters, quality, registry, sampling, search
from lexmill.plans.base import query, read
from lexmill.sources import manifests


@query("""
    WITH k AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('7.1:' || doc_id), doc_id) - 1 AS rn FROM documents), p AS (SELECT *, rn // 128 AS pool FROM k),
    b AS (SELECT doc_id, n_chars, pool, pool * 16 + (row_number() OVER (PARTITION BY pool ORDER BY n_chars, rn) - 1) // 8 AS batch FROM p)
    SELECT doc_id, pool::BIGINT AS pool, batch::BIGINT AS batch, md5('7.1:' || batch) AS batch_order FROM b""")
def bucketed_batches(spark, d):
    """W14, T-2, T-6, P8, T20"""
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return sampling.bucketed_batches(docs, "doc_id", "n_chars", 8, 16, seed=7, epoch=1).drop("n_chars")


@query("""
    WITH k AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('0.0:' || doc_id), doc_id) - 1 AS rn, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents), p AS (SELECT *, rn // 1024 AS pool FROM k),
    b AS (SELECT 'bucketed' AS kind, n_chars, pool * 64 + (row_number() OVER (PARTITION BY pool ORDER BY n_chars, rn) - 1) // 16 AS batch FROM p UNION ALL SELECT 'sequential', n_chars, seq // 16 FROM k),
    s AS (SELECT kind, batch, sum(n_chars) AS s, max(n_chars) AS m, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT kind, sum(s)::BIGINT AS used, sum(m * n)::BIGINT AS padded FROM s GROUP BY kind""")
def padding_efficiency(spark, d):
    """A4, W15, T19"""
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    a = quality.padding_efficiency(sampling.bucketed_batches(docs, "doc_id", "n_chars", 16), "n_chars", "batch").withColumn("kind", F.lit("bucketed"))
    return a.unionByName(quality.padding_efficiency(sampling.sequential_batches(docs, "doc_id", 16), "n_chars", "batch").withColumn("kind", F.lit("sequential")))


@query("""
    WITH c AS (SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) <= 5)
    SELECT source, count(*) AS picked, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id FROM c GROUP BY source""")
def capped_speakers(spark, d):
    """A cap per speaker, whose limit is the feature"""
    c = sampling.capped(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", 5, seed=3)
    return c.groupBy("source").agg(F.count("*").alias("picked"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"))


@query("""
    WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER () AS n FROM documents), k AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
    q AS (SELECT source, c, 100 * sqrt(c) / sum(sqrt(c)) OVER () AS raw FROM k), l AS (SELECT *, floor(raw) AS base FROM q), f AS (SELECT *, row_number() OVER (ORDER BY round(raw - base, 9) DESC, source) AS rr, 100 - sum(base) OVER () AS rest FROM l)
    SELECT source, max(c) AS docs, max(base + (rr <= rest)::INT)::BIGINT AS quota, count(*) FILTER (rn <= floor(n * 0.3)) AS in_top FROM f JOIN r USING (source) GROUP BY source""")
def quotas(spark, d):
    """A20, W17"""
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    q = sampling.square_root_quota(docs.groupBy("source").agg(F.count("*").alias("docs")), "source", "docs", 100)
    top = sampling.top_fraction(docs, "n_chars", "doc_id", 0.3).groupBy("source").agg(F.count("*").alias("in_top"))
    return q.join(top, "source", "left").na.fill(0, ["in_top"])


@query("""
    WITH RECURSIVE k AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY md5('5:' || user_id), user_id) AS rn FROM events GROUP BY user_id), t AS (SELECT sum(n) AS total, max(rn) AS m FROM k),
    f AS (SELECT 0::BIGINT AS rn, 0::HUGEINT AS test, 0::HUGEINT AS dev, '' AS split UNION ALL
          SELECT k.rn, CASE WHEN f.test + n <= 0.125 * total AND f.test < 0.1 * total THEN f.test + n ELSE f.test END, CASE WHEN NOT (f.test + n <= 0.125 * total AND f.test < 0.1 * total) AND f.dev + n <= 0.125 * total AND f.dev < 0.1 * total THEN f.dev + n ELSE f.dev END,
                 CASE WHEN f.test + n <= 0.125 * total AND f.test < 0.1 * total THEN 'test' WHEN f.dev + n <= 0.125 * total AND f.dev < 0.1 * total THEN 'dev' ELSE 'train' END FROM f JOIN k ON k.rn = f.rn + 1, t)
    SELECT user_id, n, split FROM f JOIN k USING (rn)""")
def speaker_splits(spark, d):
    """W19, T30, A21, J19"""
    s = sampling.speaker_split(read(spark, d, "events").select("user_id"), "user_id", 0.1, 0.1, seed=5)
    return s.groupBy("user_id", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN rn < 100 THEN 'none' WHEN rn < 100 + (n - 100) // 2 THEN 'whisper' ELSE 'conformer' END AS treatment FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)")
def treatment_assignment(spark, d):
    """W20"""
    return sampling.treatments(read(spark, d, "documents").select("doc_id"), "doc_id", 100, seed=9)


@query("""
    WITH h AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE source = 'src0'), d AS (SELECT doc_id, source, md5(text) AS k FROM documents)
    SELECT 'held out' AS side, count(*) AS n, count(DISTINCT k) AS texts FROM d WHERE k IN (SELECT k FROM h) UNION ALL SELECT 'train', count(*), count(DISTINCT k) FROM d WHERE k NOT IN (SELECT k FROM h) UNION ALL
    SELECT 'shared', count(*), count(*) FROM (SELECT k FROM d WHERE source = 'src0' INTERSECT SELECT k FROM d WHERE source <> 'src0')""")
def hold_out_by_sentence(spark, d):
    """J8, J9, U2, U4, G11"""
    docs = read(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("k"))
    held = docs.filter("source = 'src0'").select("k").distinct()
    inside, rest = docs.join(held, "k", "left_semi"), sampling.excluded(docs, held, ["k"])
    shared = sampling.shared_keys(docs.filter("source = 'src0'"), docs.filter("source <> 'src0'"), ["k"])
    side = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.count_distinct("k").alias("texts"))
    return side(inside, "held out").unionByName(side(rest, "train")).unionByName(side(shared, "shared"))


@query("""
    SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'transcribed' WHEN source IN ('src1', 'src2') THEN 'held-out speaker' WHEN n_chars < 400 THEN 'short' ELSE 'kept' END AS reason FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def pool_eligibility(spark, d):
    """F12, F28, J4, J5, J6, J7, A22, P19"""
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    done = read(spark, d, "labels").select("doc_id", F.lit(True).alias("done")).distinct()
    flagged = docs.join(done, "doc_id", "left")
    reason = quality.first_reason([("transcribed", F.col("done").isNotNull()), ("held-out speaker", F.col("source").isin("src1", "src2")), ("short", F.col("n_chars") < 400)])
    return flagged.select("doc_id", reason.alias("reason"))


@query("""
    WITH o AS (SELECT doc_id AS clip, source AS speaker, CASE WHEN source IN ('src1', 'src2') THEN 'dev' WHEN source = 'src3' THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 2 = 0)
    SELECT doc_id, CASE WHEN o.split IN ('dev', 'test') THEN o.split WHEN source IN (SELECT speaker FROM o WHERE split <> 'train') THEN 'excluded' ELSE 'train' END AS split FROM documents d LEFT JOIN o ON o.clip = d.doc_id""")
def frozen_split(spark, d):
    """J10"""
    docs = read(spark, d, "documents").select("doc_id", "source")
    split = F.when(F.col("source").isin("src1", "src2"), "dev").when(F.col("source") == "src3", "test").otherwise("train")
    old = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("clip"), F.col("source").alias("speaker"), split.alias("split"))
    return sampling.frozen_split(docs, "doc_id", "source", old).select("doc_id", "split")


@query("""
    SELECT d.doc_id, l.quality, l.toxic, string_split('pool/' || d.source || '/' || d.doc_id || '.wav', '/')[-1] AS file, d.n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def gold_join(spark, d):
    """J1, J2, J3, J11, J17"""
    docs = read(spark, d, "documents").select("doc_id", F.concat_ws("/", F.lit("pool"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))).alias("path"), "n_chars")
    joined = docs.join(read(spark, d, "labels"), "doc_id")
    return sampling.complete(joined, ["quality", "toxic"], "gold sheet").select("doc_id", "quality", "toxic", X.basename(F.col("path")).alias("file"), "n_chars")


@query("SELECT b.item_id, count(DISTINCT d.doc_id) AS leaks FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def reference_leaks(spark, d):
    """Exact containment, all items at once in a single pass over the texts"""
    items = read(spark, d, "benchmark").filter("text is not null").select("item_id", F.col("text").alias("item"))
    hits = search.contained(read(spark, d, "documents").select("doc_id", "text"), items.select("item").distinct(), "doc_id", "text", "item")
    found = hits.join(items, "item").groupBy("item_id").agg(F.count_distinct("doc_id").alias("leaks"))
    return items.select("item_id").join(found, "item_id", "left").na.fill(0, ["leaks"])


@query("SELECT w AS doc_id, CASE WHEN doc_id IS NULL THEN 'no such row' WHEN text IS NULL THEN 'no audio' END AS error, n_chars FROM (SELECT unnest([3, 17, -5, 0])::BIGINT AS w) LEFT JOIN documents ON doc_id = w")
def random_access(spark, d):
    """Rows by number; one that isn't there is an error row"""
    return manifests.rows_at(read(spark, d, "documents"), "doc_id", [3, 17, -5, 0, 3], "text").select("doc_id", "error", "n_chars")


@query("SELECT doc_id, 'text' AS text_column, text FROM documents ORDER BY doc_id LIMIT 3")
def corpus_preview(spark, d):
    """The first rows, whose number is the feature"""
    return manifests.preview(read(spark, d, "documents"), "doc_id")


@query("SELECT n_nationkey + 2 AS row_no, trim(n_name) AS \"Name\", n_regionkey::VARCHAR AS region FROM nation")
def sheet_by_header(spark, d):
    """A title, a header in another order and case, then rows"""
    n = read(spark, d, "nation")
    text = lambda c: F.col(c).cast("string")
    rows = n.select((F.col("n_nationkey") + 2).alias("row_no"), F.array(text("n_regionkey"), F.lit(None).cast("string"), F.concat(text("n_name"), F.lit(" "))).alias("cells"))
    head = spark.createDataFrame([(0, ["Nations of the world"]), (1, [" Region", "note", "NAME "])], "row_no long, cells array<string>")
    return manifests.sheet(head.unionByName(rows), ["Name", "region"])


@query("SELECT event_id, round_even(value, 2) AS start_s, round_even(value / 3, 3) AS score FROM events")
def rounded_fields(spark, d):
    """X16, T8"""
    e = read(spark, d, "events").select("event_id", F.col("value").alias("start_s"), (F.col("value") / 3).alias("score"))
    return e.select("event_id", *X.rounded({"start_s": 2, "score": 3}))


@query("""
    SELECT k, count(*) AS n FROM (SELECT 'minus' AS k, source FROM (SELECT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE lang = 'zz') UNION ALL SELECT 'keep', x FROM (SELECT source AS x FROM documents WHERE lang = 'de' UNION SELECT source FROM documents WHERE lang = 'fr') UNION ALL SELECT 'bag', lang FROM documents) GROUP BY k""")
def set_operations(spark, d):
    """U1, U3, U5"""
    docs = read(spark, d, "documents")
    s = lambda c: docs.filter(F.col("lang") == c).select("source")
    parts = [("minus", s("en").distinct().exceptAll(s("zz").distinct())), ("keep", s("de").union(s("fr")).distinct()), ("bag", docs.select("lang"))]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("k").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT conv_id, arg_max(turn, turn) AS last_turn, arg_max(md5(text), turn) AS last_md5 FROM conversations WHERE role <> 'system' GROUP BY conv_id)
    SELECT conv_id, last_turn, last_md5, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations JOIN l USING (conv_id) GROUP BY ALL""")
def last_drafts(spark, d):
    """The last record of a stem wins; long to wide"""
    c = read(spark, d, "conversations")
    last = c.filter("role <> 'system'").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by(F.md5("text"), "turn").alias("last_md5"))
    wide = c.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.count("turn"))
    return last.join(wide, "conv_id").select("conv_id", "last_turn", "last_md5", F.coalesce("user", F.lit(0)).alias("user_turns"), F.coalesce("assistant", F.lit(0)).alias("assistant_turns"))


_PUBLISHED = """
    p AS (SELECT o_custkey AS arch, o_orderkey AS k, o_orderdate AS at, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
    b AS (SELECT *, printf('v%03d', rn) AS version, min(score) OVER (PARTITION BY arch ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p),
    h AS (SELECT *, rn = 1 OR coalesce(score < best, false) OR (score IS NOT NULL AND best IS NULL) AS promoted FROM b)"""


def _published(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("arch"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return registry.auto_promoted(registry.numbered(o, "arch", "at", "k"), "arch", "score", "at", "k")


@query(f"WITH {_PUBLISHED} SELECT k, version, promoted FROM h")
def promotions(spark, d):
    """W21, W22, W26, T21"""
    return _published(spark, d).select("k", "version", "promoted")


@query(f"""
    WITH {_PUBLISHED}, r AS (SELECT arch, version, row_number() OVER (PARTITION BY arch ORDER BY rn DESC) AS back FROM h WHERE promoted), n AS (SELECT arch, printf('v%03d', max(rn) + 1) AS next_version FROM h GROUP BY arch), s AS (SELECT arch, arg_min(version, score) FILTER (score IS NOT NULL) AS best FROM h GROUP BY arch)
    SELECT r.arch, r.version AS current, count(*) OVER () > 0 AS known, q.version AS previous, next_version, best FROM r LEFT JOIN r q ON q.arch = r.arch AND q.back = 2 JOIN n ON n.arch = r.arch JOIN s ON s.arch = r.arch WHERE r.back = 1""")
def registry_state(spark, d):
    """W21, W23, W24, A31, D18, G7"""
    p = _published(spark, d)
    state = registry.state(p, "arch", "version", "at", "k").drop("promotions")
    best = registry.best(p, "score", "version", ["arch"])
    return state.join(registry.next_version(p, "arch"), "arch").join(best, "arch", "left").withColumn("known", F.lit(True))


@query(f"WITH {_PUBLISHED}, c AS (SELECT arch, arg_max(version, rn) AS current FROM h WHERE promoted GROUP BY arch) SELECT arg_min(current, arch) AS served FROM c")
def served_version(spark, d):
    """W25, T24"""
    p = _published(spark, d)
    return registry.resolve(registry.state(p, "arch", "version", "at", "k"), p, "arch", "score", "version")


@query("""
    WITH a AS (SELECT l_orderkey AS run, l_linenumber AS epoch, l_extendedprice AS wer FROM lineitem)
    SELECT run, arg_min(epoch, struct_pack(wer := wer, epoch := epoch))::BIGINT AS best_epoch, round(avg(wer) * 100)::BIGINT AS mean_loss, count(*) FILTER (epoch % 2 = 0) AS logged FROM a GROUP BY run""")
def best_epochs(spark, d):
    """A37, A38, W30; the mean sums in the order of the file, as a half of a cent turns on the order of a floating-point sum"""
    a = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("epoch"), F.col("l_extendedprice").alias("wer"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return registry.epochs(a, "run", "epoch", "wer", "file", "at").select("run", F.col("best_epoch").cast("long").alias("best_epoch"), F.round(F.col("mean") * 100).cast("long").alias("mean_loss"), "logged")


@query("""
    WITH a AS (SELECT page_id % 10 AS arch, 'k' || page_id % 4 AS setting, CASE WHEN page_id % 5 > 0 THEN page_id % 3 END AS v FROM pages), w AS (SELECT 'k' || i AS setting, CASE WHEN i <> 2 THEN i % 3 END AS v FROM range(4) t(i))
    SELECT a.arch, a.setting, count(*) AS n FROM a JOIN w USING (setting) WHERE a.v <> w.v GROUP BY 1, 2""")
def incompatible_settings(spark, d):
    """J20, G20"""
    k = F.col("page_id")
    a = read(spark, d, "pages").select((k % 10).alias("arch"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("setting"), F.when(k % 5 > 0, k % 3).alias("v"))
    w = spark.range(4).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("setting"), F.when(F.col("id") != 2, F.col("id") % 3).alias("v"))
    return registry.incompatible(a, F.broadcast(w), "setting", "v").groupBy("arch", "setting").agg(F.count("*").alias("n"))


@query("""
    WITH f AS (SELECT doc_id, source AS run_id, sha256(text) AS digest, n_chars AS size FROM documents), p AS (SELECT sha256(text) AS digest, min(doc_id) AS version FROM documents WHERE doc_id % 4 = 0 GROUP BY 1), r AS (SELECT DISTINCT source AS run_id FROM documents WHERE doc_id % 4 = 0)
    SELECT f.run_id, count(*) AS files, sum(size)::BIGINT AS bytes, min(version) AS first_version FROM f JOIN p USING (digest) WHERE f.run_id IN (SELECT run_id FROM r) GROUP BY f.run_id""")
def duplicate_weights(spark, d):
    """J12, J13, G8, A32, A33, X21, P20"""
    f = read(spark, d, "documents").select("doc_id", F.col("source").alias("run_id"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("size"))
    published = f.filter("doc_id % 4 = 0").groupBy("digest").agg(F.min("doc_id").alias("version"))
    found = registry.duplicate_files(f, published, f.filter("doc_id % 4 = 0"))
    return found.groupBy("run_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("version").alias("first_version"))


@query("""
    SELECT o_orderkey AS run, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS run_id, format('{:.2f}', o_totalprice) AS price, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS status FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def run_table(spark, d):
    """A30, F21, T-7, T-8, T-9, X33: the last runs, whose number is the feature"""
    o = read(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    return o.select(F.col("o_orderkey").alias("run"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss").alias("run_id"), F.format_string("%.2f", "o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open").alias("status"))


_VECTORS = """
    e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
    u AS (SELECT vec_id, label, i, x / n AS x FROM e JOIN n USING (vec_id)), c AS (SELECT label AS centroid, i, avg(x) AS x FROM u GROUP BY 1, 2)"""


@query(f"""
    WITH {_VECTORS}, s AS (SELECT vec_id, label, centroid, sum(u.x * c.x) AS dot FROM u JOIN c USING (i) GROUP BY 1, 2, 3), b AS (SELECT vec_id, label, arg_max(centroid, dot) AS nearest FROM s GROUP BY 1, 2)
    SELECT nearest::BIGINT AS nearest, label::BIGINT AS label, count(*) AS n FROM b GROUP BY 1, 2""")
def nearest_centroids(spark, d):
    """J18, X25, A28, D26"""
    e = read(spark, d, "embeddings")
    c = clusters.centroids(e, "embedding", "label")
    return clusters.assigned(e, c, "vec_id", "embedding").groupBy(F.col("nearest").cast("long").alias("nearest"), F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {_VECTORS}, m AS (SELECT centroid, sqrt(sum(x * x)) AS l FROM c GROUP BY 1), k AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label) SELECT label::BIGINT AS label, size, round(l * 100000)::BIGINT AS tightness FROM k JOIN m ON m.centroid = k.label")
def cluster_sizes(spark, d):
    """A28"""
    e = read(spark, d, "embeddings")
    c = clusters.centroids(e, "embedding", "label")
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v * v))
    return e.groupBy("label").agg(F.count("*").alias("size")).join(c, "label").select(F.col("label").cast("long").alias("label"), "size", F.round(norm * 100000).cast("long").alias("tightness"))
