"""Post-processing in SQL, written apart from the operators: loops by windows over tokens, suppression by a recursion over a cluster's pairs.

Two things are less general here than in the operators, and hold for the derived pages: the only long run of one character is of z, and the
texts of close regions are equal, begin alike or share no character, so that their similarity is a matter of lengths.
"""

from __future__ import annotations

PROFILES = {
    "safe": (2, False, False, False), "balanced": (2, False, True, False), "text_strong": (1, True, True, False),
    "dedup_strong": (2, False, True, True)
}
_TYPES = "('handwritten', 'printed', 'formula', 'table', 'annotation', 'image', 'graph')"
_MATH = r"[0-9=+\-−–—×*/^√∫π%≈≤≥<>()\[\]{}]"
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def _box(i: int) -> str:
    """A coordinate in whole numbers, within the page."""
    c, top = ("x1", "y1", "x2", "y2")[i], ("width", "height")[i % 2]
    return f"CASE WHEN width IS NULL THEN round_even({c}, 0)::BIGINT ELSE least(greatest(round_even({c}, 0)::BIGINT, 0), {top}) END AS b{i}"


def processed(regions: str) -> str:
    """Common tables over ``regions`` (image, cluster, o, x1 to y2, x1 null for no box, type, text, width, height).

    told: (profile, image, action), a row for each time. left_: (profile, image, pos, b0 to b3, kind, text) of the regions that stay.
    """
    profiles = ", ".join(f"('{n}', {k}, {two}, {contain}, {strong})" for n, (k, two, contain, strong) in PROFILES.items())
    return rf"""
    valid AS (SELECT *, coalesce(type, 'handwritten') NOT IN {_TYPES} AS fixed, x1 IS NULL AS no_box, {', '.join(_box(i) for i in range(4))}, row_number() OVER (PARTITION BY image ORDER BY o) AS pos FROM {regions}),
    sane AS (SELECT *, CASE WHEN fixed THEN 'handwritten' ELSE coalesce(type, 'handwritten') END AS kind, NOT no_box AND b2 > b0 AND b3 > b1 AS ok,
               NOT no_box AND (b0 <> round_even(x1, 0) OR b1 <> round_even(y1, 0) OR b2 <> round_even(x2, 0) OR b3 <> round_even(y2, 0)) AS clamped,
               trim(replace(replace(text, chr(8203), ''), chr(7), '')) AS t0 FROM valid),
    marks AS (SELECT *, kind IN ('handwritten', 'printed', 'annotation') AS is_nat, length(t0) >= 24 AND regexp_full_match(t0, '[\s\-−–—_.,·|]+') AS filler, regexp_matches(t0, 'z{{24,}}') AS run,
                regexp_extract_all(t0, '\S+') AS toks FROM sane WHERE ok),
    asked AS (SELECT DISTINCT t0, toks, len(toks) AS n, [regexp_replace(lower(x), '^{_NOT_WORD}|{_NOT_WORD}$', '', 'g') for x in toks] AS keys FROM marks
              WHERE is_nat AND NOT filler AND NOT run AND length(t0) >= 90 AND len(toks) >= 8),
    same AS (SELECT t0, n, c, i, keys[i] = keys[i + c] AS eq, len([x for x in keys[i : i + c - 1] if x <> '']) > 0 AS has
             FROM (SELECT *, unnest(generate_series(1, n - c)) AS i FROM (SELECT *, unnest(generate_series(1, least(14, n - 1))) AS c FROM asked))),
    ends AS (SELECT *, coalesce(min(CASE WHEN NOT eq THEN i END) OVER (PARTITION BY t0, c ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - c + 1) AS stop FROM same),
    loops AS (SELECT two, t0, n, c, i, 1 + (stop - i) // c AS reps, CASE WHEN two AND length(t0) >= 180 THEN 2 ELSE 3 END AS least_ FROM ends, (VALUES (false), (true)) w(two) WHERE has),
    best AS (SELECT * FROM loops WHERE reps >= least_ AND c <= n // least_ QUALIFY row_number() OVER (PARTITION BY two, t0 ORDER BY reps * c DESC, c DESC, i) = 1),
    loop AS (SELECT * FROM best WHERE (c > 1 OR reps >= 6) AND reps * c >= 6 AND reps * c / n::DOUBLE >= 0.25),
    prof AS (SELECT * FROM (VALUES {profiles}) v(profile, keep, two, contain, strong)),
    clean AS (SELECT p.profile, p.contain, p.strong, m.image, m.cluster, m.pos, m.b0, m.b1, m.b2, m.b3, m.kind,
                CASE WHEN is_nat AND filler THEN '—' WHEN is_nat AND run THEN regexp_replace(m.t0, 'z{{24,}}', 'zz', 'g')
                     WHEN is_nat AND l.t0 IS NOT NULL THEN array_to_string(list_concat(m.toks[1 : l.i - 1 + l.c * least(p.keep, l.reps)], CASE WHEN l.n - l.i + 1 - l.reps * l.c >= l.c + 3 THEN m.toks[l.i + l.reps * l.c :] ELSE [] END), ' ') ELSE m.t0 END AS text,
                CASE WHEN is_nat AND filler THEN 'dash_filler_collapsed' WHEN is_nat AND run THEN 'character_loop_collapsed' WHEN is_nat AND l.t0 IS NOT NULL THEN 'token_loop_collapsed' WHEN m.t0 <> m.text THEN 'unicode_sanitized' END AS action
              FROM marks m CROSS JOIN prof p LEFT JOIN loop l ON l.t0 = m.t0 AND l.two = p.two AND m.is_nat),
    keyed AS (SELECT *, regexp_replace(lower(text), '{_NOT_WORD}', '', 'g') AS key, ((b2 - b0) * (b3 - b1))::DOUBLE AS area, regexp_matches(text, '{_MATH}') AS math, length(text) AS len FROM clean),
    ranked AS (SELECT *, CASE WHEN kind = 'formula' AND math THEN 5 WHEN kind = 'handwritten' AND NOT math THEN 4 WHEN kind = 'printed' AND NOT math THEN 3 WHEN kind = 'annotation' THEN 2 WHEN kind = 'formula' THEN 1 ELSE 0 END AS rank,
                 least(len, 140) - 2 * greatest(0, len - 180) AS fit FROM keyed WHERE kind NOT IN ('image', 'graph')),
    met AS (SELECT a.profile, a.contain, a.strong, a.image, a.cluster, a.pos AS i, b.pos AS j, a.key AS s, b.key AS t, a.area + b.area AS both_, least(a.area, b.area) AS smaller,
              greatest(least(a.b2, b.b2) - greatest(a.b0, b.b0), 0) * greatest(least(a.b3, b.b3) - greatest(a.b1, b.b1), 0)::DOUBLE AS meet, (a.rank, a.fit, a.area) < (b.rank, b.fit, b.area) AS less,
              (a.kind = 'handwritten' AND b.kind IN ('formula', 'printed')) OR (b.kind = 'handwritten' AND a.kind IN ('formula', 'printed')) AS risky
            FROM ranked a JOIN ranked b ON a.profile = b.profile AND a.image = b.image AND a.cluster = b.cluster AND a.pos < b.pos),
    alike AS (SELECT *, meet / greatest(both_ - meet, 1e-9) AS iou, meet / greatest(smaller, 1e-9) AS ioa, s <> '' AND t <> '' AND (contains(t, s) OR contains(s, t)) AS within_,
                CASE WHEN s = t THEN 1.0 WHEN s <> '' AND t <> '' AND (starts_with(s, t) OR starts_with(t, s)) THEN 2.0 * least(length(s), length(t)) / (length(s) + length(t)) ELSE 0.0 END::DOUBLE AS sim FROM met),
    why AS (SELECT *, CASE WHEN iou >= 0.80 AND (sim >= 0.62 OR risky) THEN 'high_iou_duplicate'
                           WHEN contain AND ioa >= 0.95 AND ((s <> '' AND s = t) OR sim >= 0.90 OR (within_ AND sim >= 0.58)) THEN 'contained_text_duplicate'
                           WHEN contain AND risky AND iou >= 0.62 AND sim >= 0.72 THEN 'cross_class_duplicate'
                           WHEN strong AND ioa >= 0.90 AND (sim >= 0.78 OR within_) THEN 'strong_containment_duplicate'
                           WHEN strong AND risky AND iou >= 0.52 AND sim >= 0.58 THEN 'strong_cross_class_duplicate' END AS reason,
                   CASE WHEN s <> t AND s <> '' AND contains(t, s) THEN i WHEN s <> t AND t <> '' AND contains(s, t) THEN j WHEN less THEN i ELSE j END AS goes FROM alike),
    turns AS (SELECT profile, image, cluster, i, j, goes, reason, row_number() OVER (PARTITION BY profile, image, cluster ORDER BY i, j) AS r FROM why WHERE reason IS NOT NULL),
    fold(profile, image, cluster, r, gone, told) AS (
        SELECT profile, image, cluster, r, [goes], [reason] FROM turns WHERE r = 1
        UNION ALL SELECT x.profile, x.image, x.cluster, x.r, CASE WHEN list_has_any(f.gone, [x.i, x.j]) THEN f.gone ELSE list_append(f.gone, x.goes) END,
                         CASE WHEN list_has_any(f.gone, [x.i, x.j]) THEN f.told ELSE list_append(f.told, x.reason) END
        FROM fold f JOIN turns x ON x.profile = f.profile AND x.image = f.image AND x.cluster = f.cluster AND x.r = f.r + 1),
    done AS (SELECT profile, image, unnest(gone) AS pos, unnest(told) AS action FROM fold QUALIFY row_number() OVER (PARTITION BY profile, image, cluster ORDER BY r DESC) = 1),
    told AS (SELECT profile, image, action FROM clean WHERE action IS NOT NULL UNION ALL SELECT profile, image, action FROM done
             UNION ALL SELECT profile, image, unnest(CASE WHEN fixed THEN ['invalid_type_fixed'] ELSE [] END || CASE WHEN clamped THEN ['bbox_clamped'] ELSE [] END || CASE WHEN NOT ok THEN ['invalid_bbox_removed'] ELSE [] END) FROM sane, prof),
    left_ AS (SELECT c.* FROM clean c LEFT JOIN done g ON g.profile = c.profile AND g.image = c.image AND g.pos = c.pos WHERE g.pos IS NULL)"""


def regions_text(table: str) -> str:
    """JSON of a page's regions."""
    one = "'{\"bbox\":[' || b0 || ',' || b1 || ',' || b2 || ',' || b3 || '],\"type\":\"' || kind || '\",\"text\":' || to_json(text)::VARCHAR || '}'"
    return f"SELECT profile, image, count(*)::BIGINT AS n, '[' || string_agg({one}, ',' ORDER BY pos) || ']' AS regions FROM {table} GROUP BY profile, image"
