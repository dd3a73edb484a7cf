"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compression import quality_rules
from .jaccard import near_duplicates
from .licences import licence_spans
from .packing import pack
from .private import find_private
from .pu_quality import quality_scores
from .quantiles import LEAST, POINTS, batch_quantiles
from .ranking import search
from .recurrent import score_documents
from .site_lines import LEAST_PAGES, MOST_SHARE, drop_site_lines
from .token_counts import token_counts
from .token_files import token_ids_round_trip
from .wumanber import contamination


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(_table(spark, sf_dir, "documents"))

    def joined(only_base: bool):
        spans = F.filter("spans", lambda x: x["base"]) if only_base else F.col("spans")
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), "n_candidates"
    )


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated"
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids_round_trip(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op10_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    return licence_spans(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), "score"
    )


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of clicks by client and item prices of sale lines by brand, in eight batches by the checksum of an id."""
    clicks = _table(spark, sf_dir, "clicks").select("click_id", "client_id", "value").dropDuplicates(["click_id"])
    values = clicks.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("value").alias("money"))
    # lines of one item and vendor are counted before they meet the item, so an item with most of the lines is a few rows
    lines = _table(spark, sf_dir, "sale_lines").where("item_id is not null").groupBy("item_id", "vendor_id").agg(F.count(F.lit(1)).alias("times"))
    items = _table(spark, sf_dir, "items").select("item_id", "brand", "price")
    prices = lines.join(items.hint("merge"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), F.col("vendor_id").alias("id"), F.col("price").alias("money"), "times")
    batch = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 8
    rows = values.withColumn("times", F.lit(1).cast("long")).unionByName(prices).where("grp is not null and money is not null").select(
        "stream", "grp", batch.cast("int").alias("batch"), (F.floor(100 * F.col("money") + 0.5) + 1000 * batch).alias("x"), "times"
    )
    out = batch_quantiles(rows, ["stream", "grp"], "batch", times="times")
    return out.withColumn("within", 1000 * F.col("rank_error") <= 50 * F.col("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_private, op2_site_lines, op3_quality, op4_contamination, op5_near_duplicates, op6_compression, op7_token_files, op8_token_counts,
        op9_packing, op10_recurrent, op11_licences, op12_ranking, op13_quantiles
    )
}

ORACLE_SQL = {
    "op2_site_lines": f"""
        WITH pages AS (SELECT doc_id, text, coalesce(source, '') AS host, row_number() OVER () AS r FROM documents),
        lines AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages),
        marked AS (SELECT *, regexp_matches(line, '[^ \\t\\r\\x0b\\x0c]') AS has FROM lines),
        totals AS (SELECT host, count(*) AS n FROM pages GROUP BY host),
        boiler AS (SELECT m.host, m.line FROM marked m JOIN totals t ON m.host = t.host WHERE m.has GROUP BY m.host, m.line, t.n
                   HAVING count(DISTINCT m.r) >= {LEAST_PAGES} AND count(DISTINCT m.r) > {MOST_SHARE} * t.n),
        kept AS (SELECT m.r, m.i, m.line, b.line IS NOT NULL AS gone FROM marked m LEFT JOIN boiler b ON m.host = b.host AND m.line = b.line AND m.has),
        docs AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM kept GROUP BY r)
        SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE d.text END AS text, coalesce(d.n_lines, 0)::BIGINT AS n_lines, coalesce(d.n_dropped, 0)::BIGINT AS n_dropped
        FROM pages p LEFT JOIN docs d ON p.r = d.r
    """,
    "op4_contamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dg AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT dg.r, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
    """,
    "op12_ranking": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        q AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
        sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r),
        al AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
        tfs AS (SELECT r, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY r, t),
        weights AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, al GROUP BY t),
        scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l))))::BIGINT AS score
                   FROM q JOIN tfs USING (t) JOIN weights USING (t) JOIN sizes USING (r), al GROUP BY item_id, r),
        ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    # the rule of each answer spelled out: bounds at every point from every batch's own points, without steps or running sums
    "op13_quantiles": f"""
        WITH shifts AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        raw AS (SELECT 'value' AS stream, client_id::VARCHAR AS grp, click_id AS id, value AS money FROM (SELECT DISTINCT click_id, client_id, value FROM clicks)
                UNION ALL SELECT 'price', i.brand, l.vendor_id, i.price FROM sale_lines l JOIN items i ON l.item_id = i.item_id),
        crc AS (SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(id::VARCHAR, ''), ''), lambda s: ascii(s)::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 8 AS batch FROM (SELECT DISTINCT id FROM raw), shifts),
        counted AS (SELECT stream, grp, batch, (floor(100 * money + 0.5) + 1000 * batch)::BIGINT AS x, count(*) AS c
                    FROM raw JOIN crc ON raw.id IS NOT DISTINCT FROM crc.id WHERE grp IS NOT NULL AND money IS NOT NULL GROUP BY ALL),
        levels AS (SELECT * FROM counted UNION ALL SELECT stream, grp, -1, x, sum(c) FROM counted GROUP BY ALL),
        ranks AS (SELECT *, sum(c) OVER w AS upto, sum(c) OVER w - c AS below, row_number() OVER w AS nth, sum(c) OVER (PARTITION BY stream, grp, batch) AS n
                  FROM levels WINDOW w AS (PARTITION BY stream, grp, batch ORDER BY x)),
        points AS (SELECT * FROM ranks WHERE batch >= 0 AND (nth <= {LEAST} OR upto * {POINTS} // n > below * {POINTS} // n)),
        places AS (SELECT DISTINCT stream, grp, x FROM points),
        bounds AS (SELECT a.stream, a.grp, a.x, p.batch, any_value(p.n) AS n, coalesce(max(p.upto) FILTER (p.x <= a.x), 0) AS lo, coalesce(min(p.below) FILTER (p.x >= a.x), any_value(p.n)) AS hi
                   FROM places a JOIN points p ON a.stream = p.stream AND a.grp = p.grp GROUP BY a.stream, a.grp, a.x, p.batch),
        summaries AS (SELECT stream, grp, -1 AS batch, x, sum(lo) AS lo, sum(hi) AS hi, sum(n) AS n FROM bounds GROUP BY stream, grp, x
                      UNION ALL SELECT stream, grp, batch, x, upto, below, n FROM points),
        asked AS (SELECT s.*, i, (i * n + 9) // 10 AS target, count(*) OVER (PARTITION BY stream, grp, batch, i) AS points FROM summaries s, range(1, 10) AS r(i) WHERE n >= 20),
        sides AS (SELECT *, max(x) FILTER (lo < target) OVER w AS low, min(x) FILTER (lo >= target) OVER w AS high FROM asked WINDOW w AS (PARTITION BY stream, grp, batch, i)),
        answers AS (SELECT stream, grp, batch, i, any_value(n) AS n, any_value(target) AS target, any_value(points) AS points, arg_min(x, (greatest(0, hi + 1 - target, target - lo), x)) AS answer
                    FROM sides WHERE x = low OR x = high GROUP BY stream, grp, batch, i),
        told AS (SELECT a.*, e.x AS exact_x, b.below AS n_below, b.upto AS n_upto, greatest(0, b.below + 1 - target, target - b.upto) AS rank_error
                 FROM answers a JOIN ranks e ON a.stream = e.stream AND a.grp = e.grp AND a.batch = e.batch AND e.below < target AND target <= e.upto
                 JOIN ranks b ON a.stream = b.stream AND a.grp = b.grp AND a.batch = b.batch AND b.x = a.answer)
        SELECT stream, grp, batch::INTEGER AS batch, i::INTEGER AS i, n::BIGINT AS n, target::BIGINT AS target, exact_x, points::BIGINT AS points, answer,
               n_below::BIGINT AS n_below, n_upto::BIGINT AS n_upto, rank_error::BIGINT AS rank_error, 1000 * rank_error <= 50 * n AS within FROM told
    """,
}
