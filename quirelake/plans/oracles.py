"""SQL for the page queries, run by DuckDB on the same tables.

The derived texts are ASCII, so the look-alike letters' translation, which keeps distances and lengths, is left out here. Boxes of the
derived pages overlap by half only within their own row, so the greedy matching is each reference region's best prediction.
"""

from __future__ import annotations

from . import round_trips, run_queries, suppression, tool_queries
from .crowded import SQL as CROWDED
from .fixtures import SQL as FIXTURE


def _norm(t: str) -> str:
    for pattern, to in (
        (r"~~.*?~~\{(.*?)\}", r"\1"), (r"~~(.*?)~~", r"\1"), (r"[_\-]{3,}", "___"), (r"[ \t]+", " "), (r"\(\s+", "("), (r"\s+\)", ")"),
        (r" +\(", "("), (r" +([_^])", r"\1")
    ):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim({t})"


def _iou(a: str, b: str) -> str:
    inter = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))::DOUBLE"
    return f"({inter} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter}))"


_SOLUTION_PAGES = "SELECT DISTINCT image, source FROM gt"


def _scored(pred: str = "pr") -> str:
    """Common tables gn, pn, m (matches) and pg (page rows) over predictions ``pred``."""
    return f"""{FIXTURE},
    gn AS (SELECT *, {_norm('text')} AS n, type NOT IN ('image', 'graph') AND language <> 'other' AND legibility <> 'illegible' AS ok FROM gt),
    pn AS (SELECT *, {_norm('text')} AS n, type NOT IN ('image', 'graph') AS ok FROM {pred}),
    pairs AS (SELECT g.image, g.source, g.gi, p.pi, g.type AS gt_type, p.type AS pred_type, g.ok, g.n AS gn, p.n AS pn, g.y2 - g.y1 AS height, {_iou('g', 'p')} AS iou FROM gn g JOIN pn p ON g.image = p.image AND p.y1 < g.y2 AND p.y2 > g.y1),
    m AS (SELECT *, CASE WHEN ok THEN levenshtein(pn, gn)::DOUBLE / greatest(length(gn), 1) END AS cer, length(gn) AS chars
          FROM (SELECT *, row_number() OVER (PARTITION BY image, gi ORDER BY iou DESC, pi) AS r FROM pairs WHERE iou >= 0.5) WHERE r = 1),
    mp AS (SELECT image, count(*) AS tp, count(*) FILTER (WHERE gt_type = pred_type) AS class_correct, coalesce(sum(cer), 0) AS cer_sum, count(cer) AS cer_n FROM m GROUP BY image),
    gp AS (SELECT image, source, count(*) AS n_gt, coalesce(string_agg(n, chr(10) ORDER BY floor((y1 + y2) / 2.0 / 15), (x1 + x2) / 2.0, gi) FILTER (WHERE ok), '') AS t FROM gn GROUP BY image, source),
    pp AS (SELECT p.image, count(*) AS n_pred, coalesce(string_agg(p.n, chr(10) ORDER BY floor((y1 + y2) / 2.0 / 15), (x1 + x2) / 2.0, p.pi) FILTER (WHERE p.ok AND (m.gi IS NULL OR m.ok)), '') AS t FROM pn p LEFT JOIN m ON p.image = m.image AND p.pi = m.pi GROUP BY p.image),
    pg AS (SELECT gp.image, gp.source, n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn, coalesce(class_correct, 0) AS class_correct,
             coalesce(cer_sum, 0) AS cer_sum, coalesce(cer_n, 0) AS cer_n, CASE WHEN gp.t <> '' THEN levenshtein(coalesce(pp.t, ''), gp.t)::DOUBLE / length(gp.t) END AS page_cer, length(gp.t) AS gt_chars, length(coalesce(pp.t, '')) AS pred_chars
           FROM gp LEFT JOIN pp USING (image) LEFT JOIN mp USING (image))"""


def _metric(rows: str, keys: str = "", group: str = "") -> str:
    return f"""
    s AS (SELECT {keys} sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(class_correct)::DOUBLE AS cc, sum(cer_sum) AS cs, sum(cer_n)::BIGINT AS cn, avg(page_cer) AS pc FROM {rows} {group}),
    r AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS rc, cc / greatest(tp, 1) AS acc, coalesce(cs / nullif(cn, 0), 1) AS reg, coalesce(pc, 1) AS pag FROM s),
    f AS (SELECT *, 2 * p * rc / greatest(p + rc, 1e-9) AS f1 FROM r),
    metric AS (SELECT {keys} round(0.15 * f1 + 0.05 * acc + 0.30 * greatest(0, 1 - reg) + 0.50 * greatest(0, 1 - pag), 6) AS composite, round(f1, 6) AS det_f1, round(p, 6) AS det_precision, round(rc, 6) AS det_recall,
                 round(acc, 6) AS class_accuracy, round(reg, 6) AS region_cer, round(pag, 6) AS page_cer, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, cn AS cer_regions FROM f)"""


_BINS = {
    "chars": ((15, "0-15"), (40, "16-40"), (96, "41-96"), (180, "97-180")), "height": ((32, "0-32"), (64, "33-64"), (128, "65-128"), (256, "129-256"))
}
_LAST = {"chars": "181+", "height": "257+"}


def _bin(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {most} THEN '{label}'" for most, label in _BINS[c]) + f" ELSE '{_LAST[c]}' END"


def _type_report(name: str, pred: str = "pr") -> str:
    return f"""{name} AS (SELECT type, count(*) FILTER (WHERE k = 'gt') AS gt, count(*) FILTER (WHERE k = 'pred') AS pred, count(*) FILTER (WHERE k = 'm') AS matched, count(*) FILTER (WHERE k = 'c') AS class_correct,
             count(*) FILTER (WHERE k = 'fn') AS false_negative, count(*) FILTER (WHERE k = 'fp') AS false_positive,
             round(count(*) FILTER (WHERE k = 'm') / greatest(count(*) FILTER (WHERE k = 'gt'), 1)::DOUBLE, 6) AS recall,
             round(count(*) FILTER (WHERE k = 'm') / greatest(count(*) FILTER (WHERE k IN ('m', 'fp')), 1)::DOUBLE, 6) AS precision,
             round(count(*) FILTER (WHERE k = 'mp') / greatest(count(*) FILTER (WHERE k IN ('mp', 'fp')), 1)::DOUBLE, 6) AS precision_pred,
             round(count(*) FILTER (WHERE k = 'c') / greatest(count(*) FILTER (WHERE k = 'm'), 1)::DOUBLE, 6) AS class_accuracy, round(avg(cer), 6) AS region_cer, count(cer) AS cer_regions
           FROM (SELECT type, 'gt' AS k, NULL::DOUBLE AS cer FROM gt UNION ALL SELECT type, 'pred', NULL FROM {pred} UNION ALL SELECT gt_type, 'm', cer FROM m UNION ALL SELECT pred_type, 'mp', NULL FROM m
                 UNION ALL SELECT gt_type, 'c', NULL FROM m WHERE gt_type = pred_type
                 UNION ALL SELECT g.type, 'fn', NULL FROM gt g LEFT JOIN m USING (image, gi) WHERE m.pi IS NULL UNION ALL SELECT p.type, 'fp', NULL FROM {pred} p LEFT JOIN m USING (image, pi) WHERE m.gi IS NULL) GROUP BY type)"""


_USABLE = "trim(text) <> '' AND language = 'uk' AND legibility <> 'illegible' AND type NOT IN ('image', 'graph')"
_KEY = "x1 || ',' || y1 || ',' || x2 || ',' || y2 || '|' || type"
_CANON = "CASE WHEN type IN ('handwritten', 'printed', 'formula', 'table', 'annotation') THEN type ELSE 'handwritten' END"
_N_VALID = "CASE WHEN n > 50 THEN greatest(20, floor(n * 0.1)) ELSE greatest(1, floor(n / 5)) END"
_SPLIT = f"""split AS (SELECT image, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('42|' || image), image) <= {_N_VALID} THEN 'valid' ELSE 'train' END AS split
                       FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM ({_SOLUTION_PAGES})))"""
_CROPS = rf"crops AS (SELECT image, source, gi AS idx, type, text, 'train/' || regexp_replace(image, '\.[^.]*$', '') || '_r' || lpad((row_number() OVER (PARTITION BY image ORDER BY gi) - 1)::VARCHAR, 6, '0') || '.jpg' AS image_path, 1.0::DOUBLE AS weight FROM gt WHERE {_USABLE})"
_ERRORS = "SELECT image, source, round(page_cer, 6) AS page_cer, round(coalesce(page_cer, 0), 6) AS page_cer_diag, gt_chars, pred_chars, n_gt AS gt_regions, n_pred AS pred_regions FROM pg"
_SURE = "sure AS (SELECT image, source, o, x1, y1, x2, y2, type, text, conf, row_number() OVER (PARTITION BY image ORDER BY o) - 1 AS pi FROM preds WHERE conf >= {at})"
_WORDS = r"regexp_extract_all(trim(text), '\S+')"
_UNIQUE = f"len(list_distinct({_WORDS})) / len({_WORDS})::DOUBLE"
_ALNUM = "length(regexp_replace(trim(text), '[^A-Za-z0-9]', '', 'g'))"


def _grid(confs: tuple[float, ...]) -> str:
    """Confidences one by one: the metric's common tables, renamed, for each."""
    parts = []
    for i, at in enumerate(confs):
        body = _scored("sure").replace("    gn AS", f"    {_SURE.format(at=at)},\n    gn AS", 1)
        parts.append(
            f"SELECT * FROM (WITH {body}, {_metric('pg')} SELECT *, {i}::BIGINT AS ordinal, {at}::DOUBLE AS conf, 0.5::DOUBLE AS iou FROM metric)"
        )
    return " UNION ALL ".join(parts)


def _stays(name: str, limit: float, kind: str = "type") -> str:
    """Tables name_r and name_k (by recursion, the boxes kept so far of a page's type), and name: image and pi of predictions that stay."""
    inter = "greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0)"
    iou = f"({inter})::DOUBLE / ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {inter})"
    box = "{{'pi': {0}pi, 'x1': {0}x1, 'y1': {0}y1, 'x2': {0}x2, 'y2': {0}y2}}"
    return f"""{name}_r AS (SELECT *, {kind} AS kind, row_number() OVER (PARTITION BY image, {kind} ORDER BY conf DESC, pi) AS k FROM pr),
    {name}_k AS (SELECT image, kind, k, [{box.format('')}] AS kept FROM {name}_r WHERE k = 1
        UNION ALL SELECT r.image, r.kind, r.k, CASE WHEN len(list_filter(n.kept, lambda b: {iou} > {limit})) > 0 THEN n.kept ELSE list_append(n.kept, {box.format('r.')}) END
        FROM {name}_k n JOIN {name}_r r ON r.image = n.image AND r.kind = n.kind AND r.k = n.k + 1),
    {name} AS (SELECT image, b.pi AS pi FROM (SELECT image, unnest(kept) AS b FROM (SELECT *, row_number() OVER (PARTITION BY image, kind ORDER BY k DESC) AS last FROM {name}_k) WHERE last = 1))"""


def _detector_grid(confs: tuple[float, ...], limits: tuple[float, ...]) -> str:
    parts = []
    for k, (at, limit) in enumerate((c, m) for c in confs for m in limits):
        sure = f"{_stays('kept', limit)},\n    {_SURE.format(at=at).replace('FROM preds WHERE', 'FROM pr SEMI JOIN kept USING (image, pi) WHERE')}"
        body = _scored("sure").replace("    gn AS", f"    {sure},\n    gn AS", 1)
        parts.append(
            f"SELECT * FROM (WITH RECURSIVE {body}, {_metric('pg')} SELECT *, {k}::BIGINT AS ordinal, {at}::DOUBLE AS conf, 0.5::DOUBLE AS iou, {limit}::DOUBLE AS nms FROM metric)"
        )
    return " UNION ALL ".join(parts)


def _compared(at: float) -> tuple[str, str]:
    body = _scored("sure").replace("    gn AS", f"    {_SURE.format(at=at)},\n    gn AS", 1)
    return f"WITH {_scored()}", f"WITH {body}"


_ALL, _CONFIDENT = _compared(0.7)
_METRICS = ("composite", "det_f1", "det_precision", "det_recall", "class_accuracy", "region_cer", "page_cer", "tp", "fp", "fn", "cer_regions")
_LONG = "SELECT unnest([" + ", ".join(f"'{m}'" for m in _METRICS) + "]) AS metric, unnest([" + ", ".join(
    f"{m}::DOUBLE" for m in _METRICS
) + "]) AS value FROM metric"


def _percentile(c: str, p: float) -> str:
    return f"list_sort(list({c}))[round_even((count({c}) - 1) * {p}, 0)::BIGINT + 1]"


ORACLE_SQL: dict[str, str] = {
    "detector_grid": _detector_grid((0.55, 0.8), (0.05, 0.45, 0.7)),
    "suppressed_regions": f"WITH RECURSIVE {FIXTURE}, {_stays('a', 0.05)}, {_stays('b', 0.05, repr('any'))} " + " UNION ALL ".join(
        f"SELECT image, {by} AS by_type, count(*) AS n, round(sum(conf), 6) AS conf, sum(y1)::BIGINT AS y1 FROM pr SEMI JOIN {name} USING (image, pi) GROUP BY image"
        for name, by in (("a", "true"), ("b", "false"))
    ),
    "page_metric": f"WITH {_scored()}, {_metric('pg')} SELECT * FROM metric",
    "metric_by_source": f"WITH {_scored()}, {_metric('pg', 'source,', 'GROUP BY GROUPING SETS ((source), ())')} SELECT * FROM metric",
    "report_by_type": f"WITH {_scored()}, {_type_report('t')} SELECT * FROM t",
    "report_by_length": f"WITH {_scored()} SELECT {_bin('chars')} AS bin, count(*) AS n, round(avg(cer), 6) AS region_cer FROM m WHERE cer IS NOT NULL GROUP BY 1",
    "report_by_height": f"WITH {_scored()} SELECT {_bin('height')} AS bin, count(*) AS n, round(avg(cer), 6) AS region_cer FROM m WHERE cer IS NOT NULL GROUP BY 1",
    "report_confusion": f"WITH {_scored()} SELECT gt_type AS gt, pred_type AS pred, count(*) AS n FROM m GROUP BY 1, 2",
    "report_page_errors": f"WITH {_scored()} {_ERRORS}",
    "report_worst_pages": f"WITH {_scored()} {_ERRORS} ORDER BY coalesce(pg.page_cer, 0) DESC, image LIMIT 20",
    "report_diagnosis": f"""WITH {_scored()}, {_metric('pg')} SELECT unnest(['page_text_order', 'detection_recall', 'class_accuracy', 'region_text', 'composite_good', 'composite_strong']) AS "check",
        unnest([page_cer <= region_cer + 0.10, det_recall >= 0.70, class_accuracy >= 0.80, region_cer <= 0.30, composite >= 0.75, composite >= 0.85]) AS ok, unnest([page_cer, det_recall, class_accuracy, region_cer, composite, composite]) AS observed FROM metric""",
    "report_mean_cer_nonempty": f"WITH {_scored()} SELECT round(avg(cer), 6) AS eval_cer, count(*) AS n FROM m WHERE cer IS NOT NULL AND chars > 0",
    "matches": f"WITH {_scored()} SELECT image, gi::BIGINT AS gi, pi::BIGINT AS pi, gt_type, pred_type, round(cer, 6) AS cer, chars::BIGINT AS chars, height::BIGINT AS height FROM m",
    "overlaps": f"WITH {FIXTURE} SELECT a.image, a.pi::BIGINT AS i, b.pi::BIGINT AS j, a.type AS type_i, b.type AS type_j, 1.0::DOUBLE AS iou, 1.0::DOUBLE AS ioa FROM pr a JOIN pr b ON a.image = b.image AND a.pi < b.pi AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2",
    "overlap_type_pairs": f"""WITH {FIXTURE}, o AS (SELECT a.image, a.pi AS i, b.pi AS j, a.type AS type_i, b.type AS type_j FROM pr a JOIN pr b ON a.image = b.image AND a.pi < b.pi AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2),
        first AS (SELECT *, row_number() OVER (PARTITION BY type_i, type_j ORDER BY image, i, j) AS r, count(*) OVER (PARTITION BY type_i, type_j) AS n FROM o)
        SELECT type_i, type_j, n FROM first WHERE r = 1 ORDER BY n DESC, image, i, j LIMIT 12""",
    "submission_summary": f"""WITH {FIXTURE}, c AS (SELECT g.image, count(p.pi) AS n FROM ({_SOLUTION_PAGES}) g LEFT JOIN pr p USING (image) GROUP BY g.image), o AS (SELECT a.image FROM pr a JOIN pr b ON a.image = b.image AND a.pi < b.pi AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2)
        SELECT (SELECT count(*) FROM c) AS rows, (SELECT sum(n)::BIGINT FROM c) AS regions_total, (SELECT round_even(sum(n) / count(*)::DOUBLE, 2) FROM c) AS regions_mean, (SELECT median(n)::DOUBLE FROM c) AS regions_median, (SELECT {_percentile('n', 0.9)} FROM c) AS regions_p90, (SELECT max(n) FROM c) AS regions_max,
          (SELECT round_even(avg(length(text)), 2) FROM pr WHERE text <> '') AS text_len_mean, (SELECT {_percentile('length(text)', 0.9)} FROM pr WHERE text <> '') AS text_len_p90, (SELECT max(length(text)) FROM pr) AS text_len_max,
          (SELECT count(*) FROM o) AS overlap_pairs_iou80, (SELECT count(*) FROM o) AS containment_pairs_ioa95, (SELECT count(DISTINCT image) FROM o) AS images_with_overlap_iou80, (SELECT count(*) FROM c WHERE n = 0) AS empty_rows, (SELECT count(*) FROM pr WHERE length(text) >= 180) AS texts_ge_180""",
    "submission_types": f"WITH {FIXTURE} SELECT type, count(*) AS n FROM pr GROUP BY 1",
    "submission_checks": f"""WITH {FIXTURE} SELECT unnest(['regions_valid', 'images_unique', 'no_missing_images', 'no_extra_images']) AS "check", unnest([(SELECT count(*) = 0 FROM pr WHERE type NOT IN ('handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph')), true, true, true]) AS ok, unnest([0, 0, 0, 0])::BIGINT AS observed""",
    "parse_round_trip": f"WITH {FIXTURE} SELECT image, pi::BIGINT AS pi, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2, type, text FROM pr",
    "normalized_regions": f"WITH {FIXTURE} SELECT image, pi::BIGINT AS pi, length({_norm('text')}) AS chars, {_norm('text')} AS text FROM pr",
    "region_predicates": f"""WITH {FIXTURE}, x AS (SELECT source, type NOT IN ('image', 'graph') AS drawn, language = 'uk' AS uk, language <> 'other' AS own, legibility = 'legible' AS leg, trim(text) <> '' AS has, length(trim(text)) BETWEEN 3 AND 120 AS mid FROM gt)
        SELECT source, count(*) FILTER (WHERE drawn AND own AND leg) AS is_scorable, count(*) FILTER (WHERE drawn AND uk AND leg AND has) AS audit_scorable, count(*) FILTER (WHERE drawn AND uk AND leg AND has) AS train_usable, count(*) FILTER (WHERE drawn AND uk) AS pseudo_usable, count(*) FILTER (WHERE drawn AND uk AND mid) AS synth_text_usable, count(*) FILTER (WHERE drawn) AS order_scorable FROM x GROUP BY source""",
    "region_geometry": f"""WITH {FIXTURE}, b AS (SELECT *, least(x2, 800) AS cx2, least(y2, 1200) AS cy2 FROM pr)
        SELECT image, pi::BIGINT AS pi, ((x2 - x1) * (y2 - y1))::DOUBLE AS area, CASE WHEN fit THEN round((x1 + cx2) / 1600.0::DOUBLE, 6) END AS cx, CASE WHEN fit THEN round((y1 + cy2) / 2400.0::DOUBLE, 6) END AS cy, CASE WHEN fit THEN round((cx2 - x1) / 800.0::DOUBLE, 6) END AS bw, CASE WHEN fit THEN round((cy2 - y1) / 1200.0::DOUBLE, 6) END AS bh,
          x1 < 0 OR y1 < 0 OR x2 > 800 OR y2 > 1200 AS outside, CASE WHEN cw >= 5 AND ch >= 5 THEN cw ELSE 64 END::BIGINT AS crop_w, CASE WHEN cw >= 5 AND ch >= 5 THEN ch ELSE 32 END::BIGINT AS crop_h, {_KEY} AS key
        FROM (SELECT *, cx2 - x1 >= 5 AND cy2 - y1 >= 5 AS fit, least(800, x2 + 4) - greatest(0, x1 - 4) AS cw, least(1200, y2 + 4) - greatest(0, y1 - 4) AS ch FROM b)""",
    "reading_order": f"""WITH {FIXTURE} SELECT image, row_number() OVER (PARTITION BY image ORDER BY late, CASE WHEN late THEN 0 ELSE floor((y1 + y2) / 2.0 / 15) END, CASE WHEN late THEN 0 ELSE (x1 + x2) / 2.0 END, pi) - 1 AS place, {_KEY} AS key FROM (SELECT *, type IN ('image', 'graph') AS late FROM pr)""",
    "text_plausibility": rf"""WITH {FIXTURE} SELECT type,
          count(*) FILTER (WHERE {_ALNUM} > 0 AND (len({_WORDS}) < 4 OR {_UNIQUE} >= 0.4) AND (length(trim(text)) <= 5 OR length(regexp_replace(trim(text), '[A-Za-z0-9 .,!?;:''\-()\[\]]', '', 'g')) / length(trim(text))::DOUBLE <= 0.5)) AS confident,
          count(*) FILTER (WHERE length(trim(text)) BETWEEN 2 AND 300 AND {_ALNUM} > 0 AND {_ALNUM} / length(trim(text))::DOUBLE >= 0.3 AND (len({_WORDS}) <= 3 OR {_UNIQUE} >= 0.4)) AS valid,
          count(*) FILTER (WHERE regexp_matches(text, '[0-9=+\-*/^%<>()\[\]{{}}]')) AS math FROM pr GROUP BY type""",
    "generation_settings": f"""WITH {FIXTURE}, c AS (SELECT type, {_CANON} AS k FROM pr) SELECT type, count(*) AS n, sum(CASE k WHEN 'handwritten' THEN 128 WHEN 'printed' THEN 160 WHEN 'formula' THEN 256 WHEN 'table' THEN 384 ELSE 96 END)::BIGINT AS tokens, max(CASE WHEN k IN ('handwritten', 'printed', 'annotation') THEN 1.05::DOUBLE END) AS penalty FROM c GROUP BY type""",
    "metric_grid": _grid((0.5, 0.7, 0.9)),
    "metric_grid_best": f"SELECT * FROM ({_grid((0.5, 0.7, 0.9))}) ORDER BY composite DESC, ordinal LIMIT 1",
    "viewer_removed": f"WITH {FIXTURE}, k AS (SELECT image, gi::BIGINT AS idx, {_KEY} AS key, type, text FROM gt) SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM (SELECT image, {_KEY} AS key FROM pr) p WHERE p.image = k.image AND p.key = k.key)",
    "run_comparison": f"SELECT type, a.region_cer AS baseline, b.region_cer AS candidate, round(b.raw - a.raw, 6) AS delta FROM ({_ALL}, {_type_report('t').replace('round(avg(cer), 6) AS region_cer', 'round(avg(cer), 6) AS region_cer, avg(cer) AS raw')} SELECT type, region_cer, raw FROM t) a FULL JOIN ({_CONFIDENT}, {_type_report('t', 'sure').replace('round(avg(cer), 6) AS region_cer', 'round(avg(cer), 6) AS region_cer, avg(cer) AS raw')} SELECT type, region_cer, raw FROM t) b USING (type)",
    "dataset_audit": f"""WITH {FIXTURE}, x AS (SELECT type, length(text) AS l, {_USABLE} AND legibility = 'legible' AS ok FROM gt), n AS (SELECT type, count(*) AS c FROM x GROUP BY type)
        SELECT count(*) AS total_regions, count(*) FILTER (WHERE ok) AS scorable_regions, round_even(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 4) AS scorable_ratio, round_even(avg(l) FILTER (WHERE ok), 1) AS avg_text_len, max(l) FILTER (WHERE ok) AS max_text_len, count(*) FILTER (WHERE ok AND l > 256) AS long_texts,
          CASE WHEN (SELECT max(c) / min(c)::DOUBLE FROM n) > 10 THEN (SELECT coalesce(string_agg(type, ',' ORDER BY type), '') FROM n WHERE c < (SELECT max(c) * 0.1 FROM n)) ELSE '' END AS rare_types FROM x""",
    "source_histogram": f"WITH {FIXTURE} SELECT coalesce(source, 'unknown') AS source, count(*) AS pages FROM ({_SOLUTION_PAGES}) GROUP BY 1",
    "stratified_split": f"WITH {FIXTURE}, {_SPLIT} SELECT * FROM split",
    "leakage": f"WITH {FIXTURE}, {_SPLIT} SELECT count(*) AS n FROM (SELECT image FROM split WHERE split = 'train' INTERSECT SELECT image FROM split WHERE split = 'valid')",
    "type_weights": f"WITH {FIXTURE}, c AS (SELECT {_CANON} AS type, count(*) AS n FROM gt GROUP BY 1) SELECT type, n, round(least(4.0, sqrt(max(n) OVER () / n::DOUBLE)), 6) AS multiplier FROM c",
    "crop_manifest": f"WITH {FIXTURE}, {_CROPS} SELECT * REPLACE (idx::BIGINT AS idx) FROM crops",
    "sample_weights": f"WITH {FIXTURE}, {_CROPS}, c AS (SELECT type, count(*) AS n FROM crops GROUP BY 1) SELECT type, n, round(n * least(4.0, sqrt(max(n) OVER () / n::DOUBLE)), 6) AS weight FROM c",
    "quota_subset": f"""WITH {FIXTURE}, {_CROPS}, c AS (SELECT type, count(*) AS n FROM crops GROUP BY 1), q AS (SELECT type, greatest(1, round_even(500 * sqrt(n) / sum(sqrt(n)) OVER (), 0)) AS quota FROM c),
        r AS (SELECT type, md5('42|' || image_path) AS h, image_path, row_number() OVER (PARTITION BY type ORDER BY md5('42|' || image_path), image_path) AS r FROM crops)
        SELECT type, count(*) AS n FROM (SELECT r.type FROM r JOIN q USING (type) ORDER BY r > quota, h, image_path LIMIT 500) GROUP BY type""",
    "manifest_union": f"WITH {FIXTURE}, {_CROPS}, n AS (SELECT count(*) AS n FROM crops) SELECT origin, n, round(n * w, 6) AS weight, CASE WHEN origin = 'silver' THEN n ELSE 0 END AS silver_texts, CASE WHEN origin = 'gold' THEN n ELSE 0 END AS positions FROM n, (VALUES ('gold', 1.0::DOUBLE), ('silver', 0.5), ('synth', 0.3)) v(origin, w)",
    "capped_pages": rf"""WITH {FIXTURE}, {_CROPS}, p AS (SELECT regexp_extract(image, 'doc_(\d+)_', 1)::BIGINT AS page_no, count(*) AS n FROM crops GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p) SELECT page_no, n FROM r WHERE ahead < 2000""",
    "detector_label_files": f"""WITH {FIXTURE}, b AS (SELECT *, least(x2, 800) AS cx2, least(y2, 1200) AS cy2, CASE type WHEN 'handwritten' THEN 0 WHEN 'printed' THEN 1 WHEN 'formula' THEN 2 WHEN 'table' THEN 3 WHEN 'annotation' THEN 4 WHEN 'image' THEN 5 ELSE 6 END AS c FROM gt)
        SELECT image, string_agg(printf('%d %.6f %.6f %.6f %.6f', c, (x1 + cx2) / 1600.0::DOUBLE, (y1 + cy2) / 2400.0::DOUBLE, (cx2 - x1) / 800.0::DOUBLE, (cy2 - y1) / 1200.0::DOUBLE), chr(10) ORDER BY gi) AS label FROM b WHERE cx2 - x1 >= 5 AND cy2 - y1 >= 5 GROUP BY image""",
    "class_weight_hint": f"WITH {FIXTURE}, n AS (SELECT type, count(*) AS n FROM gt GROUP BY 1) SELECT round(least(1.5, 0.7 * pow(max(n) / min(n)::DOUBLE, 0.2)), 6) AS cls_weight FROM n",
    "valid_pseudo_labels": rf"WITH {FIXTURE} SELECT image, pi::BIGINT AS pi, text FROM pr WHERE length(trim(text)) BETWEEN 2 AND 300 AND {_ALNUM} > 0 AND {_ALNUM} / length(trim(text))::DOUBLE >= 0.3 AND (len({_WORDS}) <= 3 OR {_UNIQUE} >= 0.4)",
    "distinct_texts": f"WITH {FIXTURE} SELECT DISTINCT trim(text) AS text FROM pr WHERE trim(text) <> ''",
    "metric_comparison": f"SELECT metric, a.value AS baseline, b.value AS candidate, round(b.value - a.value, 6) AS delta FROM ({_ALL}, {_metric('pg')} {_LONG}) a FULL JOIN ({_CONFIDENT}, {_metric('pg')} {_LONG}) b USING (metric)",
    "progress_latest": "SELECT 'user_' || user_id AS image, max(event_id) AS seq, arg_max(event_type, event_id) AS source, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id",
    "progress_pending": "SELECT 'user_' || c_custkey AS image, c_mktsegment AS source FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "progress_coverage": "SELECT c_mktsegment AS source, count(u) AS done, count(*) AS target, count(u) = count(*) AS complete FROM customer LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) ON c_custkey = u GROUP BY 1",
    "sample_order": rf"""WITH {FIXTURE}, sample AS (SELECT DISTINCT image, regexp_extract(image, 'doc_(\d+)_', 1)::BIGINT * 1000000 + regexp_extract(image, '_(\d+)\.jpg', 1)::BIGINT AS place FROM gt
        UNION ALL SELECT 'doc_' || doc_id || '_none.jpg', doc_id * 1000000 + 999999 FROM documents)
        SELECT place, image, coalesce(n, 0) AS n FROM sample LEFT JOIN (SELECT image, count(*) AS n FROM pr GROUP BY 1) USING (image)""",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sessions": """WITH a AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM a)
        SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY 1, 2""",
    "lineitem_pricing": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "top_orders_by_segment": "SELECT * FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rank <= 10",
}

_PROCESSED = f"WITH RECURSIVE {CROWDED}, {suppression.processed('crowd')}"
_PAGES = "(SELECT DISTINCT profile, image FROM crowd, prof)"
ORACLE_SQL |= {
    "postprocess_profiles": f"{_PROCESSED}, full_ AS ({suppression.regions_text('left_')}) SELECT profile, image, coalesce(n, 0) AS n, coalesce(regions, '[]') AS regions FROM {_PAGES} LEFT JOIN full_ USING (profile, image)",
    "postprocess_actions": f"{_PROCESSED} SELECT profile, action, count(*) AS n FROM told GROUP BY ALL",
    "profile_audit": f"""{_PROCESSED}, b AS (SELECT image, count(*) AS n FROM crowd GROUP BY 1), a AS (SELECT profile, image, count(*) AS n FROM left_ GROUP BY ALL), t AS (SELECT DISTINCT profile, image FROM told)
        SELECT profile, sum(b.n)::BIGINT AS regions_before, sum(coalesce(a.n, 0))::BIGINT AS regions_after, count(*) FILTER (WHERE t.image IS NOT NULL OR b.n <> coalesce(a.n, 0)) AS affected_pages
        FROM {_PAGES} JOIN b USING (image) LEFT JOIN a USING (profile, image) LEFT JOIN t USING (profile, image) GROUP BY profile""",
}


# Flags and repeats of tokens, without back-references.
_RUN_OF_12 = "|".join(f"\\x{{{ord(c):x}}}{{12,}}" for c in [*map(chr, range(32, 127)), "\n", *"ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"])


def _repeated(words: str, least: int, times: int) -> str:
    """Whether a word of ``least`` characters or more stands ``times`` times in a row in a list of lower-cased tokens: signs may stand before the first and after the last."""
    middle = " AND ".join(
        [rf"regexp_full_match({words}[i + 1], '[\p{{L}}\p{{N}}_]{{{least},}}')"] + [f"{words}[i + {k}] = {words}[i + 1]" for k in range(2, times - 1)]
    )
    ends = rf"regexp_extract({words}[i], '[\p{{L}}\p{{N}}_]+$') = {words}[i + 1] AND regexp_extract({words}[i + {times - 1}], '^[\p{{L}}\p{{N}}_]+') = {words}[i + 1]"
    return f"len([i for i in generate_series(1, len({words}) - {times - 1}) if {middle} AND {ends}]) > 0"


def _flags(text: str, words: str) -> str:
    return f"""list_filter([CASE WHEN length({text}) >= 180 THEN 'long_text' END, CASE WHEN regexp_matches({text}, '{_RUN_OF_12}') THEN 'character_loop' END,
        CASE WHEN {_repeated(words, 2, 5)} THEN 'token_loop' END, CASE WHEN regexp_matches({text}, '(?:\\s*[—–_\\-]\\s*){{8,}}') THEN 'dash_loop' END], lambda x: x IS NOT NULL)"""


_STRUCK = r"regexp_replace(regexp_replace(coalesce(text, ''), '~~.*?~~\{(.*?)\}', '\1', 'g'), '~~(.*?)~~', '\1', 'g')"
_RAW_METRIC = "0.15 * f1 + 0.05 * acc + 0.30 * greatest(0, 1 - reg) + 0.50 * greatest(0, 1 - pag) AS composite, f1 AS det_f1, p AS det_precision, rc AS det_recall, acc AS class_accuracy, reg AS region_cer, pag AS page_cer, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, cn AS cer_regions"
_FLAT = "flat AS (SELECT image, o // 2 AS cluster, o, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, type, text, NULL::BIGINT AS width, NULL::BIGINT AS height FROM pr)"


def _profile_metric(profile: str) -> str:
    kept = f"pq AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY pos) - 1 AS pi, b0 AS x1, b1 AS y1, b2 AS x2, b3 AS y2, kind AS type, text FROM left_ WHERE profile = '{profile}')"
    body = _scored("pq").replace("    gn AS", f"    {_FLAT}, {suppression.processed('flat')}, {kept},\n    gn AS", 1)
    return f"SELECT '{profile}' AS profile, * FROM (WITH RECURSIVE {body}, {_metric('pg')} SELECT {_RAW_METRIC} FROM f)"


_WHOLE = ("tp", "fp", "fn", "cer_regions")
_DELTAS = ", ".join(
    f"{c}, a.{c} - b.{c} AS delta_{c}" if c in _WHOLE else f"round(a.{c}, 6) AS {c}, round(a.{c} - b.{c}, 6) AS delta_{c}" for c in _METRICS
).replace(", tp,", ", a.tp,").replace(", fp,", ", a.fp,").replace(", fn,", ", a.fn,").replace(", cer_regions,", ", a.cer_regions,")
ORACLE_SQL |= {
    "text_flag_counts": f"WITH w AS (SELECT coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents) SELECT flag, count(*) AS n FROM (SELECT unnest({_flags('t', 'w')}) AS flag FROM w) GROUP BY flag",
    "target_texts": f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace({_STRUCK}, '\\s+', ' ', 'g')) AS t FROM documents)",
    "postprocess_earlier": f"""WITH {FIXTURE}, x AS (SELECT *, regexp_extract_all(text, '\\S+') AS w, regexp_extract_all(lower(text), '\\S+') AS lw FROM pr),
        changed AS (SELECT count(*) AS n FROM x WHERE (length(text) >= 24 AND regexp_full_match(text, '[\\s\\-−–—_.,·|]+'))
                      OR (len(w) >= 8 AND (len([i for i in generate_series(1, len(w) - 5) if w[i : i + 3] = w[i + 2 : i + 5]]) > 0 OR {_repeated('lw', 3, 4)}))),
        twice AS (SELECT count(*) AS n FROM pr a JOIN pr b ON a.image = b.image AND a.o + 1 = b.o AND a.o % 2 = 0 WHERE a.type NOT IN ('image', 'graph') AND b.type NOT IN ('image', 'graph'))
        SELECT 'text_cleaned' AS action, n FROM changed WHERE n > 0 UNION ALL SELECT 'duplicates_removed', n FROM twice WHERE n > 0""",
    "profile_scores": f"WITH a AS ({' UNION ALL '.join(_profile_metric(p) for p in suppression.PROFILES)}), b AS (SELECT * FROM (WITH {_scored()}, {_metric('pg')} SELECT {_RAW_METRIC} FROM f)) SELECT a.profile, {_DELTAS} FROM a CROSS JOIN b",
    "viewer_regions": f"""WITH {FIXTURE}, x AS (SELECT *, {_KEY} AS key, regexp_extract_all(lower(text), '\\S+') AS lw FROM pr),
        raw AS (SELECT image, {_KEY} AS key, arg_max(text, gi) AS raw_text FROM gt GROUP BY ALL),
        twin AS (SELECT a.image, a.pi, b.pi AS other FROM pr a JOIN pr b ON a.image = b.image AND a.pi <> b.pi AND a.o // 2 = b.o // 2)
        SELECT x.image, x.pi::BIGINT AS id, x.type, raw.raw_text, array_to_string(list_concat({_flags('x.text', 'x.lw')}, list_filter([CASE WHEN t.other IS NOT NULL THEN 'overlap_iou80' END, CASE WHEN t.other IS NOT NULL THEN 'containment_ioa95' END,
            CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 800 OR y2 > 1200 THEN 'out_of_bounds' END, CASE WHEN raw.raw_text <> x.text THEN 'text_changed' END], lambda y: y IS NOT NULL)), ',') AS flags, coalesce(t.other::VARCHAR, '') AS overlap_with
        FROM x LEFT JOIN raw ON x.image = raw.image AND x.key = raw.key LEFT JOIN twin t ON x.image = t.image AND x.pi = t.pi""",
}
ORACLE_SQL |= tool_queries.ORACLE_SQL | round_trips.ORACLE_SQL

ORACLE_SQL |= {
    "sharded_metric": ORACLE_SQL["page_metric"],
    "sharded_types": ORACLE_SQL["report_by_type"],
    "sharded_quantiles": f"WITH {_scored()}, v AS (SELECT 'page_cer' AS report, round(page_cer * 1000000)::BIGINT AS v FROM pg WHERE page_cer IS NOT NULL UNION ALL SELECT 'chars', chars::BIGINT FROM m)"
    " SELECT report, share, count(*) AS n, list_sort(list(v))[greatest(ceil(share * count(*)), 1)::BIGINT] AS value FROM v, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS share) GROUP BY report, share",
    "made_sentences": r"""WITH w AS (SELECT w, row_number() OVER (ORDER BY w) AS place FROM (SELECT DISTINCT trim(unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS w FROM documents) WHERE length(w) >= 2),
        n AS (SELECT count(*) AS v FROM w),
        s AS (SELECT i, unnest(generate_series(0, 2 + ('0x' || substr(md5('42|length|' || i), 1, 15))::BIGINT % 10)) AS k FROM range((SELECT count(*) FROM documents)) AS r(i)),
        c AS (SELECT i, k, ('0x' || substr(md5('42|word|' || i || '|' || k), 1, 15))::BIGINT % (SELECT v FROM n) + 1 AS place FROM s),
        t AS (SELECT i, string_agg(w, ' ' ORDER BY k) AS t FROM c JOIN w USING (place) GROUP BY i)
        SELECT min(i) AS id, t || CASE WHEN ('0x' || substr(md5('42|end|' || i), 1, 15))::BIGINT % 10 < 3 THEN substr('.,!?:', (('0x' || substr(md5('42|sign|' || i), 1, 15))::BIGINT % 5 + 1)::BIGINT, 1) ELSE '' END AS text FROM t GROUP BY text""",
    "sketched_texts": f"WITH {FIXTURE} SELECT type, count(DISTINCT text) AS texts, count(*) AS n, true AS distinct_ok, true AS p50_ok, true AS p90_ok FROM pr GROUP BY type",
    # a row counts in a window unless the greatest time of earlier batches, less what may be late, has reached the window's end
    "stream_windows": f"""WITH c AS (SELECT epoch_us(ts) AS us, kind, value, floor(epoch_us(arrived_at) / ({run_queries.DAYS} * 86400000000.0))::BIGINT AS batch FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL),
        tops AS (SELECT batch, max(us) AS top FROM c GROUP BY batch),
        marks AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {run_queries.LATE} * 3600000000 AS mark FROM tops),
        w AS (SELECT kind, value, mark, (us // {run_queries.SLIDE * 3600000000} - k) * {run_queries.SLIDE * 3600} AS window_start FROM c JOIN marks USING (batch), range(0, {run_queries.SIZE // run_queries.SLIDE}) AS r(k))
        SELECT window_start::BIGINT AS window_start, kind, count(*) AS n, round(sum(value), 2) AS total FROM w WHERE mark IS NULL OR (window_start + {run_queries.SIZE * 3600}) * 1000000 > mark GROUP BY window_start, kind""",
}
