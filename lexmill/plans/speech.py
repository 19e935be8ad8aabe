"""Queries over turns, frames, scores and language models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import intervals, language_model as lm, ordering, quality
from lexmill.plans.base import TURNS, query, read, sql_spoken, turns

_PAIRS = f"""
    p AS (SELECT conv_id, turn, role, trim({sql_spoken('text')}) AS t, lead(trim({sql_spoken('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
    q AS (SELECT conv_id, turn, role, translate(t, 'ɛɔ', '{{}}') AS r, translate(coalesce(nxt, ''), 'ɛɔ', '{{}}') AS h, (conv_id * 104729 + turn * 7919) % 1000 AS score, (conv_id * 31 + turn) % 120 AS secs FROM p),
    e AS (SELECT *, levenshtein(trim(r), trim(h)) AS edits, length(trim(r)) AS n FROM q)"""


def _pairs(spark, d):
    """Each turn's text as reference, the next turn's as hypothesis; score and seconds from the keys."""
    t = X.folded(F.col("text"))
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", t.alias("r"))
    c = c.withColumn("h", F.coalesce(F.lead("r").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    c = c.withColumn("score", (F.col("conv_id") * 104729 + F.col("turn") * 7919) % 1000).withColumn("secs", (F.col("conv_id") * 31 + F.col("turn")) % 120)
    return c.withColumn("edits", F.levenshtein(F.trim("r"), F.trim("h")).cast("long")).withColumn("n", F.length(F.trim("r")).cast("long"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, edits::BIGINT AS edits, n, round(1000000 * CASE WHEN n = 0 THEN (h <> '')::INT ELSE edits / n END)::BIGINT AS cer_ppm FROM e")
def character_errors(spark, d):
    """X8, X10, J17, T5, T6"""
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", "edits", "n", F.round(1000000 * X.cer(F.col("r"), F.col("h"))).cast("long").alias("cer_ppm"))


@query()
def word_errors(spark, d):
    """X8, X9 on whole texts; tests hold it against a plain edit distance"""
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", X.levenshtein_words(X.words(F.col("r")), X.words(F.col("h"))).alias("word_edits"), F.size(X.words(F.col("r"))).alias("words"))


@query(f"""WITH {_PAIRS} SELECT role, count(*) AS n, round(100000 * avg(CASE WHEN n = 0 THEN (h <> '')::INT ELSE edits / n END))::BIGINT AS macro, round(100000 * sum(edits) / sum(n))::BIGINT AS micro FROM e GROUP BY role""")
def error_rates(spark, d):
    """A14, A15, T4"""
    p = _pairs(spark, d)
    return p.groupBy("role").agg(F.count("*").alias("n"), F.round(100000 * F.avg(X.cer(F.col("r"), F.col("h")))).cast("long").alias("macro"), F.round(100000 * F.sum("edits") / F.sum("n")).cast("long").alias("micro"))


@query(f"""
    WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id, turn) - 1 AS rn, count(*) OVER () AS total FROM e), f AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS share)
    SELECT round(share * 100)::BIGINT AS percent, count(*) AS kept, sum(edits)::BIGINT AS edits, sum(n)::BIGINT AS chars, sum(secs)::BIGINT AS seconds FROM k, f WHERE rn < floor(total * share) GROUP BY share HAVING count(*) >= 5""")
def calibration(spark, d):
    """A17, T-5, W17: cumulative sums at five cuts; ranks come without a single-task window"""
    p = _pairs(spark, d).withColumn("down", -F.col("score"))
    total = p.count()
    shares = F.array(*(F.lit(x) for x in (0.2, 0.4, 0.6, 0.8, 1.0)))
    rows = ordering.ranked(p, "down", "conv_id", "turn").select("edits", "n", "secs", "rn", F.explode(shares).alias("share"))
    kept = rows.filter(F.col("rn") < F.floor(F.lit(total) * F.col("share"))).groupBy("share").agg(F.count("*").alias("kept"), F.sum("edits").alias("edits"), F.sum("n").alias("chars"), F.sum("secs").alias("seconds"))
    return kept.filter("kept >= 5").select(F.round(F.col("share") * 100).cast("long").alias("percent"), "kept", "edits", "chars", "seconds")


@query(f"""
    WITH {_PAIRS}, t AS (SELECT unnest([0, 250, 500, 750, 990]) AS least), m AS (SELECT median(score) AS mid, count(*) AS total FROM e)
    SELECT least::BIGINT AS least, count(*) FILTER (score >= least) AS kept, sum(edits) FILTER (score >= least)::BIGINT AS edits, sum(n) FILTER (score >= least)::BIGINT AS chars, count(*) FILTER (score >= least) >= 20 AS measured, max(round(mid * 2))::BIGINT AS double_median, max(total)::BIGINT AS total FROM e, t, m GROUP BY least""")
def threshold_bands(spark, d):
    """A18, A19"""
    p = _pairs(spark, d)
    bands = F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 250, 500, 750, 990)))).alias("least")
    ok = F.col("score") >= F.col("least")
    out = p.select("score", "edits", "n", bands).groupBy("least").agg(F.count(F.when(ok, 1)).alias("kept"), F.sum(F.when(ok, F.col("edits"))).alias("edits"), F.sum(F.when(ok, F.col("n"))).alias("chars"), (F.count(F.when(ok, 1)) >= 20).alias("measured"), F.count("*").alias("total"))
    mid = quality.exact_median(p, "score", "mid").select(F.round(F.col("mid") * 2).cast("long").alias("double_median"))  # one row
    return out.crossJoin(F.broadcast(mid))


@query(f"""
    WITH {_PAIRS}, s AS (SELECT 'ALL' AS subset, * FROM e UNION ALL SELECT 'user', * FROM e WHERE role = 'user' UNION ALL SELECT 'long', * FROM e WHERE n > 300 UNION ALL SELECT 'none', * FROM e WHERE n < 0)
    SELECT subset, count(*) AS n_rows, CASE WHEN count(*) >= 5 THEN sum(edits)::BIGINT END AS edits, sum(n)::BIGINT AS chars FROM s GROUP BY subset""")
def subset_scores(spark, d):
    """Overlapping subsets, so a row counts in each it belongs to"""
    p = _pairs(spark, d)
    names = F.filter(F.array(F.lit("ALL"), F.when(F.col("role") == "user", F.lit("user")), F.when(F.col("n") > 300, F.lit("long")), F.when(F.col("n") < 0, F.lit("none"))), lambda x: x.isNotNull())
    out = p.select("edits", "n", F.explode(names).alias("subset")).groupBy("subset").agg(F.count("*").alias("n_rows"), F.sum("edits").alias("e"), F.sum("n").alias("chars"))
    return out.select("subset", "n_rows", F.when(F.col("n_rows") >= 5, F.col("e")).alias("edits"), "chars")


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round(1000000 * CASE WHEN h = '' THEN 0.0 ELSE 1 - least(1.0, levenshtein(h, r) / length(h)) END)::BIGINT AS agreement_ppm, round(1000 * CASE WHEN secs > 0 THEN length(r) / secs ELSE 0 END)::BIGINT AS millirate FROM e")
def agreement(spark, d):
    """X26, X27"""
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", F.round(1000000 * X.agreement(F.col("r"), F.col("h"))).cast("long").alias("agreement_ppm"), F.round(1000 * X.chars_per_second(F.col("r"), F.col("secs"))).cast("long").alias("millirate"))


_ORDER = 4
_LINES = f"(SELECT conv_id * 100 + turn AS id, trim({sql_spoken('text')}) AS line FROM conversations)"
_GRAMS = f"""
    l AS (SELECT id, line, repeat(chr(2), {_ORDER - 1}) || line AS p FROM {_LINES} WHERE line <> ''),
    a AS (SELECT id, i, substr(p, (i + {_ORDER - 1})::BIGINT, 1) AS ch, substr(p, i::BIGINT, {_ORDER - 1}) AS history FROM l, generate_series(1, length(line)) t(i)),
    g AS (SELECT substr(history, ({_ORDER} - k)::BIGINT, k::BIGINT) AS context, ch, count(*) AS n FROM a, range({_ORDER}) r(k) GROUP BY 1, 2),
    p AS (SELECT * FROM g WHERE context = '' OR n >= 2), tot AS (SELECT context, sum(n) AS total FROM p GROUP BY context)"""


def _lines(spark, d):
    return read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), X.folded(F.col("text")).alias("line")).filter("line <> ''")


@query(f"WITH {_GRAMS} SELECT md5(context) AS context_md5, ch, n, total::BIGINT AS total FROM p JOIN tot USING (context)")
def ngram_table(spark, d):
    """Character n-grams of whole texts, pruned, with totals"""
    g = lm.with_totals(lm.pruned(lm.counts(_lines(spark, d), order=_ORDER)))
    return g.select(F.md5("context").alias("context_md5"), "ch", "n", "total")


@query(f"WITH {_GRAMS} SELECT count(DISTINCT context) AS contexts, count(*) FILTER (context = '') AS vocabulary, sum(n) FILTER (context = '')::BIGINT AS total_counts FROM p")
def ngram_description(spark, d):
    """A11, A13"""
    return lm.describe(lm.pruned(lm.counts(_lines(spark, d), order=_ORDER)))


_SCORED = f"""{_GRAMS},
    q AS (SELECT DISTINCT history, ch FROM a),
    b AS (SELECT q.history, q.ch, k, ln(n / total) + ({_ORDER - 1} - k) * ln(0.4) AS lp FROM q, range({_ORDER}) r(k) JOIN p ON p.context = substr(q.history, ({_ORDER} - k)::BIGINT, k::BIGINT) AND p.ch = q.ch JOIN tot ON tot.context = p.context),
    f AS (SELECT history, ch, arg_max(lp, k) AS lp FROM b GROUP BY history, ch),
    s AS (SELECT id, sum(coalesce(lp, -20 + {_ORDER - 1} * ln(0.4))) AS score, count(*) AS chars FROM a LEFT JOIN f USING (history, ch) GROUP BY id)"""


@query(f"WITH {_SCORED} SELECT id, round(score * 1000)::BIGINT AS milliscore, chars FROM s")
def lm_scores(spark, d):
    """J15, X18, X19, T10, T11"""
    lines = _lines(spark, d)
    g = lm.pruned(lm.counts(lines, order=_ORDER))
    return lm.scores(lines, g, "id", order=_ORDER).select("id", F.round(F.col("score") * 1000).cast("long").alias("milliscore"), "chars")


@query(f"WITH {_SCORED} SELECT round(exp(-sum(score) / sum(chars)) * 100000)::BIGINT AS perplexity FROM s")
def lm_perplexity(spark, d):
    """A12"""
    lines = _lines(spark, d)
    g = lm.pruned(lm.counts(lines, order=_ORDER))
    return lm.perplexity(lm.scores(lines, g, "id", order=_ORDER)).select(F.round(F.col("perplexity") * 100000).cast("long").alias("perplexity"))


@query("SELECT CASE WHEN rn > total - 50 THEN 'held out' ELSE 'train' END AS part, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS total FROM documents) GROUP BY 1")
def lm_hold_out(spark, d):
    """The tail of the ordered stream is held out"""
    head, last = ordering.tail(read(spark, d, "documents").select("doc_id"), 50, "doc_id")
    parts = head.withColumn("part", F.lit("train")).unionByName(last.withColumn("part", F.lit("held out")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


_MERGED = f"""
    w AS (SELECT *, lag(speaker) OVER o AS was FROM {TURNS} WINDOW o AS (PARTITION BY rec_id ORDER BY s, e, event_id)),
    r AS (SELECT *, sum(CASE WHEN was = speaker THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY s, e, event_id) AS run FROM w),
    g AS (SELECT *, s - max(e) OVER (PARTITION BY rec_id, run ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM r),
    i AS (SELECT *, sum(CASE WHEN gap <= 500000 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, run ORDER BY s, e, event_id) AS isl FROM g),
    m AS (SELECT rec_id, speaker, min(s) AS s, max(e) AS e, count(*) AS pieces FROM i GROUP BY rec_id, speaker, run, isl)"""


@query(f"WITH {_MERGED} SELECT rec_id, speaker, s, e, pieces FROM m")
def merged_turns(spark, d):
    """W1, T-1, D13"""
    return intervals.merge_turns(turns(spark, d), 500_000, tie="event_id")


@query(f"""
    WITH g AS (SELECT *, s - max(e) OVER (PARTITION BY rec_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {TURNS}),
    i AS (SELECT *, sum(CASE WHEN gap < 300000 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY s, e, event_id) AS isl FROM g),
    m AS (SELECT rec_id, min(s) AS s, max(e) AS e, count(*) AS pieces FROM i GROUP BY rec_id, isl)
    SELECT rec_id, greatest(0, s - 100000) AS s, least(2000000000000000, e + 100000) AS e, pieces FROM m WHERE e - s >= 350000""")
def speech_regions(spark, d):
    """W2, F14, F15, T14, T16"""
    merged = intervals.merge_turns(turns(spark, d), 300_000, speaker=None, tie="event_id", strict=True)
    return intervals.padded(intervals.drop_short(merged, 350_000), 100_000, F.lit(2_000_000_000_000_000)).select("rec_id", "s", "e", "pieces")


@query("""
    WITH f AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value > 20 AS active FROM events),
    g AS (SELECT *, frame - row_number() OVER (PARTITION BY rec_id ORDER BY frame) AS g FROM f WHERE active)
    SELECT rec_id, min(frame) AS first, max(frame) + 1 AS stop FROM g GROUP BY rec_id, g""")
def active_runs(spark, d):
    """W3"""
    rn = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    f = read(spark, d, "events").select(F.col("user_id").alias("rec_id"), rn.alias("frame"), (F.col("value") > 20).alias("active"))
    return intervals.active_runs(f, "rec_id", "frame", "active")


@query(f"""
    WITH f AS (SELECT rec_id, speaker, min(s) AS first, count(*) AS n FROM {TURNS} GROUP BY 1, 2)
    SELECT rec_id, speaker, printf('SPEAKER_%02d', row_number() OVER (PARTITION BY rec_id ORDER BY first, speaker) - 1) AS label, n, (row_number() OVER (PARTITION BY rec_id ORDER BY speaker) - 1) % 8 AS palette FROM f""")
def relabelled_speakers(spark, d):
    """W6, X32"""
    t = intervals.relabel(turns(spark, d)).groupBy("rec_id", "speaker", "label").agg(F.count("*").alias("n"))
    return t.withColumn("palette", ((F.dense_rank().over(W.partitionBy("rec_id").orderBy("speaker")) - 1) % 8).cast("long"))


@query(f"""
    WITH r AS (SELECT event_id, s, e, e - s AS size FROM {TURNS}), w AS (SELECT event_id, s + k * 750000 AS w_start, least(s + k * 750000 + 1500000, e) AS w_end FROM r, LATERAL (SELECT unnest(range(CASE WHEN size <= 1500000 THEN 1 ELSE ceil((size - 1500000) / 750000.0)::BIGINT + 1 END)) AS k))
    SELECT event_id, count(*) AS windows, min(w_start) AS first_start, max(w_end) AS last_end, sum(w_end - w_start)::BIGINT AS covered FROM w WHERE w_end - w_start >= 500000 GROUP BY event_id""")
def embedding_windows(spark, d):
    """W7"""
    w = intervals.windows(turns(spark, d), 1_500_000, 750_000, 500_000)
    return w.groupBy("event_id").agg(F.count("*").alias("windows"), F.min("w_start").alias("first_start"), F.max("w_end").alias("last_end"), F.sum(F.col("w_end") - F.col("w_start")).alias("covered"))


_FRAMES = """
    x AS (SELECT user_id AS rec_id, row_number() OVER o - 1 AS i, avg(value * value) OVER f AS ms, count(*) OVER f AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    f AS (SELECT rec_id, (i // 2)::BIGINT AS frame, ms, 20 * log10(sqrt(greatest(ms, 1e-12))) AS db FROM x WHERE n = 3 AND i % 2 = 0)"""


@query(f"WITH {_FRAMES} SELECT rec_id, frame, round(db * 10000)::BIGINT AS db FROM f")
def frame_energies(spark, d):
    """W8, X24"""
    s = read(spark, d, "events").withColumnRenamed("user_id", "rec_id")
    f = intervals.frame_means(s, "rec_id", "event_id", "value", 3, 2)
    return f.select("rec_id", "frame", F.round(X.decibels(F.col("ms")) * 10000).cast("long").alias("db"))


@query(f"""
    WITH {_FRAMES}, q AS (SELECT rec_id, greatest(quantile_cont(db, 0.10) + 8.0, quantile_cont(db, 0.95) - 35.0) AS threshold FROM f GROUP BY rec_id)
    SELECT rec_id, round(max(threshold) * 10000)::BIGINT AS threshold, count(*) AS frames, count(*) FILTER (db > threshold) AS speech FROM f JOIN q USING (rec_id) GROUP BY rec_id""")
def speech_thresholds(spark, d):
    """A25, A26"""
    s = read(spark, d, "events").withColumnRenamed("user_id", "rec_id")
    f = intervals.frame_means(s, "rec_id", "event_id", "value", 3, 2).withColumn("db", X.decibels(F.col("ms")))
    both = f.join(intervals.speech_threshold(f, "rec_id", "db"), "rec_id")
    return both.groupBy("rec_id").agg(F.round(F.max("threshold") * 10000).cast("long").alias("threshold"), F.count("*").alias("frames"), F.count(F.when(F.col("db") > F.col("threshold"), 1)).alias("speech"))


@query("""
    SELECT conv_id, list_sort(list(DISTINCT role)) AS speakers, count(DISTINCT role) AS n_speakers, count(*) FILTER (trim(text) = '') AS empty_turns, count(*) FILTER (trim(text) <> '') AS utterances, sum(length(text))::BIGINT AS chars, sum(len(string_split(trim(text), ' ')))::BIGINT AS words FROM conversations GROUP BY conv_id""")
def diarization_summary(spark, d):
    """A29, A34, F16, D14, D15"""
    t = F.trim("text")
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("speakers"), F.count_distinct("role").alias("n_speakers"), F.count(F.when(t == "", 1)).alias("empty_turns"), F.count(F.when(t != "", 1)).alias("utterances"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split(t, " "))).alias("words"))


@query(f"""
    WITH t AS (SELECT event_id, rec_id, s, e, min(s) OVER (PARTITION BY rec_id) AS lo, max(e) OVER (PARTITION BY rec_id) AS hi FROM {TURNS})
    SELECT event_id, floor(1000000 * (s - lo) / (hi - lo)::DOUBLE)::BIGINT AS left_ppm, floor(1000000 * greatest(0.004, (e - s) / (hi - lo)::DOUBLE))::BIGINT AS width_ppm FROM t WHERE hi > lo""")
def timeline_geometry(spark, d):
    """X31"""
    t = turns(spark, d)
    span = t.groupBy("rec_id").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).filter("hi > lo")
    both = t.join(span, "rec_id")
    size = (F.col("hi") - F.col("lo")).cast("double")
    return both.select("event_id", F.floor(1000000 * (F.col("s") - F.col("lo")) / size).alias("left_ppm"), F.floor(1000000 * F.greatest(F.lit(0.004), (F.col("e") - F.col("s")) / size)).alias("width_ppm"))


@query("""
    WITH f AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, (floor(value) % 4)::BIGINT AS best, value FROM events),
    w AS (SELECT *, lag(best) OVER (PARTITION BY utt ORDER BY frame) AS was FROM f)
    SELECT utt, string_agg(best::VARCHAR, ',' ORDER BY frame) FILTER (best <> 3 AND (was IS NULL OR was <> best)) AS decoded, count(*) FILTER (best <> 3) AS voiced, round(10000 * coalesce(avg(exp(-value / 100)) FILTER (best <> 3), 0))::BIGINT AS confidence FROM w GROUP BY utt""")
def greedy_decoding(spark, d):
    """Best label by frame from one-hot posteriors"""
    best = (F.floor("value") % 4).cast("int")
    posteriors = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == best, 1.0).otherwise(0.0))
    f = read(spark, d, "events").select(F.col("user_id").alias("utt"), "event_id", "value", X.arg_max(posteriors).alias("best"))
    voiced = F.col("best") != 3
    g = f.groupBy("utt").agg(F.sort_array(F.collect_list(F.struct("event_id", "best"))).alias("x"), F.count(F.when(voiced, 1)).alias("voiced"), F.avg(F.when(voiced, F.exp(-F.col("value") / 100))).alias("c"))
    g = g.withColumn("b", F.col("x.best"))
    decoded = F.array_join(X.greedy_ctc(F.col("b"), 3).cast("array<string>"), ",")
    return g.select("utt", F.when(decoded != "", decoded).alias("decoded"), "voiced", F.round(10000 * F.coalesce("c", F.lit(0.0))).cast("long").alias("confidence"))


@query("""
    WITH f AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, (floor(value / 60) % 6)::BIGINT AS state FROM events), w AS (SELECT *, lag(state) OVER (PARTITION BY utt ORDER BY frame) AS was FROM f),
    r AS (SELECT *, sum(CASE WHEN was = state THEN 0 ELSE 1 END) OVER (PARTITION BY utt ORDER BY frame) AS run FROM w)
    SELECT utt, ((state - 1) // 2)::BIGINT AS idx, min(frame) AS first, max(frame) + 1 AS stop FROM r WHERE state % 2 = 1 GROUP BY utt, run, state""")
def alignment_spans(spark, d):
    """W13, D11"""
    rn = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    f = read(spark, d, "events").select(F.col("user_id").alias("utt"), rn.alias("frame"), (F.floor(F.col("value") / 60) % 6).alias("state"))
    return intervals.path_spans(f, "utt", "frame", "state")


@query("""
    WITH l AS (SELECT user_id AS utt, event_type AS mel, event_id, ln(value + 1e-6) AS x FROM events), s AS (SELECT utt, mel, avg(x) AS m, stddev_samp(x) AS sd FROM l GROUP BY 1, 2)
    SELECT event_id, round(1000 * (x - m) / (sd + 1e-6))::BIGINT AS normal FROM l JOIN s USING (utt, mel)""")
def normalised_features(spark, d):
    """Sample deviation; of one frame null"""
    f = read(spark, d, "events").select("event_id", F.col("user_id").alias("utt"), F.col("event_type").alias("mel"), F.log(F.col("value") + 1e-6).alias("x"))
    s = f.groupBy("utt", "mel").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    return f.join(s, ["utt", "mel"]).select("event_id", F.round(1000 * (F.col("x") - F.col("m")) / (F.col("sd") + 1e-6)).cast("long").alias("normal"))


@query("""
    WITH w AS (SELECT user_id AS run, event_id, value < 5 AS bad FROM events), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY event_id) AS isl FROM w), n AS (SELECT run, isl, sum(bad::INT) AS n FROM i GROUP BY 1, 2)
    SELECT run, max(n)::BIGINT AS longest, max(n) >= 3 AS degenerate FROM n GROUP BY run""")
def loss_streaks(spark, d):
    """F26, W30, Z5"""
    out = intervals.streak(read(spark, d, "events").withColumnRenamed("user_id", "run"), "run", ["event_id"], F.col("value") < 5)
    return out.select("run", "longest", (F.col("longest") >= 3).alias("degenerate"))


@query("""
    WITH x AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id FROM events), t AS (SELECT event_id AS turn_id, user_id AS rec_id, (event_id % 13) / 4.0::DOUBLE AS start_s, (event_id % 13) / 4.0::DOUBLE + value / 100 AS end_s FROM events)
    SELECT turn_id, count(*) AS samples, min(i) AS first, max(i) AS last FROM t JOIN x ON x.rec_id = t.rec_id AND i >= floor(start_s * 16) AND i < floor(end_s * 16) GROUP BY turn_id""")
def turn_samples(spark, d):
    """J16, P13, F30"""
    e = read(spark, d, "events").withColumnRenamed("user_id", "rec_id")
    x = e.select("rec_id", (F.row_number().over(W.partitionBy("rec_id").orderBy("event_id")) - 1).cast("long").alias("i"))
    start = (F.col("event_id") % 13) / 4.0
    t = e.select(F.col("event_id").alias("turn_id"), "rec_id", start.alias("start_s"), (start + F.col("value") / 100).alias("end_s"))
    return intervals.slice_samples(x, t, 16).groupBy("turn_id").agg(F.count("*").alias("samples"), F.min("i").alias("first"), F.max("i").alias("last"))
