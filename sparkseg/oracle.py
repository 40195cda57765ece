"""SQL of the registered queries, written for DuckDB over the same tables.

Neighbourhoods are self-joins on shifted places here, where the engine uses windows.
"""

from __future__ import annotations

import re


def _byte(offset: int) -> str:
    return f"least(255, greatest(0, CAST(floor((CAST(embedding[((CASE WHEN odd = 1 THEN p - p % 4 ELSE p END) + {offset}) % 64 + 1] AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST(8 AS DOUBLE)) AS INT) * 32))"


def _linear(ch: str) -> str:
    x = f"(CAST({ch} AS DOUBLE) / 255.0::DOUBLE)"
    return f"CASE WHEN {x} <= 0.04045::DOUBLE THEN {x} / 12.92::DOUBLE ELSE pow(({x} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def _f(t: str) -> str:
    return f"CASE WHEN {t} > 0.008856451679::DOUBLE THEN cbrt({t}) ELSE 7.787037037::DOUBLE * {t} + 0.137931034483::DOUBLE END"


def _xyz(m: tuple[str, str, str], white: str) -> str:
    return f"({m[0]}::DOUBLE * lr + {m[1]}::DOUBLE * lg + {m[2]}::DOUBLE * lb) / {white}::DOUBLE"


def _scaled(ch: str, low: str, high: str) -> str:
    return f"round(CASE WHEN {high} - {low} < 1e-9::DOUBLE THEN 0.0::DOUBLE ELSE ({ch} - {low}) / ({high} - {low}) END, 9)"


def _shifted(name: str, source: str, offsets: str, clamp: bool = False) -> str:
    """Each place of a source with the places that the offsets lead to."""
    r, c = ("least(greatest(p.r + o.dr, 1), e.rows)", "least(greatest(p.c + o.dc, 1), e.cols)") if clamp else ("p.r + o.dr", "p.c + o.dc")
    return f"{name} AS (SELECT p.image_id, p.r, p.c, o.dr, o.dc, {r} AS tr, {c} AS tc FROM {source} p JOIN ext e USING (image_id) CROSS JOIN ({offsets}) o)"


def _square(radius: int) -> str:
    return f"SELECT CAST(i AS INT) AS dr, CAST(j AS INT) AS dc FROM range({-radius}, {radius + 1}) a(i), range({-radius}, {radius + 1}) b(j)"


_CROSS = "SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dr, dc)"
_AT = "ON q.image_id = s.image_id AND q.r = s.tr AND q.c = s.tc"


def _box(name: str, source: str, value: str, radius: int, combine: str) -> str:
    return f"""{name}_found AS (SELECT s.image_id, s.r, s.c, {combine}(q.{value}) AS found FROM square{radius} s JOIN {source} q {_AT} GROUP BY s.image_id, s.r, s.c),
{name} AS (SELECT image_id, r, c, p.{value} AS own, found FROM {source} p JOIN {name}_found USING (image_id, r, c))"""


def _unique(radius: int) -> str:
    a = _box(f"most{radius}", "tied", "psi", radius, "max")
    b = f"peak{radius} AS (SELECT image_id, r, c, CAST(own = found AS INT) AS peak FROM most{radius})"
    c = _box(f"peaks{radius}", f"peak{radius}", "peak", radius, "sum")
    d = f"top{radius} AS (SELECT image_id, r, c, own = 1 AND found = 1 AS top FROM peaks{radius})"
    return ",\n".join((a, b, c, d))


def _edge(name: str, label: str) -> str:
    return f"""{name} AS (SELECT s.image_id, s.r, s.c, bool_or(q.{label} <> s.{label}) AS edge FROM own4 s
 JOIN blocks q {_AT} GROUP BY s.image_id, s.r, s.c)"""


def _adjacent(name: str, label: str) -> str:
    return f"""{name} AS (SELECT s.image_id, s.{label} AS src, q.{label} AS dst, count(*) AS w FROM own4 s
 JOIN blocks q {_AT} WHERE s.{label} <> q.{label} AND s.{label} > 0 AND q.{label} > 0 GROUP BY ALL)"""


_COUNT = """CASE WHEN (p.r IN (1, e.rows)) AND (p.c IN (1, e.cols)) THEN 3.0::DOUBLE WHEN (p.r IN (1, e.rows)) OR (p.c IN (1, e.cols)) THEN 5.0::DOUBLE ELSE 8.0::DOUBLE END"""

PARTS = [
    "vec AS (SELECT vec_id, label AS lab, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings)",
    "grid AS (SELECT k, lab, p, (k // 250) % 2 AS odd FROM vec, range(0, 64) t(p))",
    "cell AS (SELECT g.k, g.lab, g.p, g.odd, v.embedding FROM grid g JOIN vec v ON v.k = CASE WHEN g.odd = 1 THEN g.k - g.k % 5 ELSE g.k END)",
    f"px AS (SELECT CAST(k // 250 AS BIGINT) AS image_id, CAST(k % 250 + 1 AS INT) AS r, CAST(p + 1 AS INT) AS c, {_byte(0)} AS red, {_byte(20)} AS green, {_byte(41)} AS blue, CAST(lab * 4 + p // 16 AS INT) AS region FROM cell)",
    "blocks AS (SELECT *, CAST(((r - 1) // 5) * 8 + (c - 1) // 8 + 1 AS INT) AS label FROM px)",
    "ext AS (SELECT image_id, max(r) AS rows, max(c) AS cols FROM px GROUP BY image_id)",
    "grays AS (SELECT *, CAST(round(0.298936::DOUBLE * red + 0.587043::DOUBLE * green + 0.114021::DOUBLE * blue) AS INT) AS gray FROM px)",
    _shifted("square1", "px", _square(1)),
    _shifted("square3", "px", _square(3)),
    _shifted("cross4", "px", _CROSS),
    "own4 AS (SELECT s.image_id, s.r, s.c, s.tr, s.tc, p.label, p.region, p.region2 FROM cross4 s JOIN blocks p USING (image_id, r, c))",
    _shifted("clamped", "px", _square(1), clamp=True),
    f"nine AS (SELECT s.*, CAST(q.gray AS DOUBLE) AS g FROM clamped s JOIN grays q {_AT})",
    """grad AS (SELECT image_id, r, c, sum(g * -dc * (2 - abs(dr))) AS gx, sum(g * -dr * (2 - abs(dc))) AS gy FROM nine GROUP BY image_id, r, c)""",
    "edges AS (SELECT image_id, r, c, sqrt(gx * gx + gy * gy) AS edge FROM grad)",
    "ranked AS (SELECT image_id, edge, row_number() OVER (PARTITION BY image_id ORDER BY edge) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM edges)",
    "wanted AS (SELECT DISTINCT image_id, n, p, least(greatest(p / 100.0::DOUBLE * n + 0.5::DOUBLE, 1.0::DOUBLE), n::DOUBLE) AS rank FROM ranked, (VALUES (0), (60), (80), (100)) t(p))",
    """thr AS (SELECT w.image_id, w.p, a.edge + (w.rank - floor(w.rank)) * (b.edge - a.edge) AS threshold FROM wanted w
 JOIN ranked a ON a.image_id = w.image_id AND a.k = floor(w.rank) JOIN ranked b ON b.image_id = w.image_id AND b.k = ceil(w.rank))""",
    f"lin AS (SELECT *, {_linear('red')} AS lr, {_linear('green')} AS lg, {_linear('blue')} AS lb FROM px)",
    "xyz AS (SELECT *, " + ", ".join(f"{_xyz(m, w)} AS {n}" for m, w, n in ((("0.4124564", "0.3575761", "0.1804375"), "0.9504", "tx"), (("0.2126729", "0.7151522", "0.0721750"), "1.0", "ty"), (("0.0193339", "0.1191920", "0.9503041"), "1.0888", "tz"))) + " FROM lin)",
    f"fxyz AS (SELECT *, {_f('tx')} AS fx, {_f('ty')} AS fy, {_f('tz')} AS fz FROM xyz)",
    "labs AS (SELECT image_id, r, c, region, 116.0::DOUBLE * fy - 16.0::DOUBLE AS l, 500.0::DOUBLE * (fx - fy) AS a, 200.0::DOUBLE * (fy - fz) AS b FROM fxyz)",
    "ends AS (SELECT image_id, max(l) AS l1, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM labs GROUP BY image_id)",
    f"val AS (SELECT image_id, r, c, region, {_scaled('l', '0.0::DOUBLE', 'l1')} AS l, {_scaled('a', 'a0', 'a1')} AS a, {_scaled('b', 'b0', 'b1')} AS b FROM labs JOIN ends USING (image_id))",
    "vars AS (SELECT image_id, var_samp(l) AS vl, var_samp(a) AS va, var_samp(b) AS vb FROM val GROUP BY image_id)",
    "alphas AS (SELECT *, least(2 * vl / (va + vb), 1.0::DOUBLE) AS alpha FROM vars)",
    "rests AS (SELECT *, (3 - alpha) / (ln(greatest(va, vb) / least(va, vb)) + 1) AS rest FROM alphas)",
    "para AS (SELECT image_id, round(alpha, 9) AS alpha, round(CASE WHEN vb > va THEN 3 - alpha - rest ELSE rest END, 9) AS beta, round(CASE WHEN vb > va THEN rest ELSE 3 - alpha - rest END, 9) AS gamma FROM rests)",
    "own1 AS (SELECT s.image_id, s.r, s.c, s.tr, s.tc, p.l, p.a, p.b FROM square1 s JOIN val p USING (image_id, r, c))",
    f"diffs AS (SELECT s.image_id, s.r, s.c, sum((q.l - s.l) * (q.l - s.l)) AS sl, sum((q.a - s.a) * (q.a - s.a)) AS sa, sum((q.b - s.b) * (q.b - s.b)) AS sb FROM own1 s JOIN val q {_AT} GROUP BY s.image_id, s.r, s.c)",
    "diff AS (SELECT image_id, r, c, sqrt(alpha * sl + beta * sa + gamma * sb) AS d FROM diffs JOIN para USING (image_id))",
    f"dens AS (SELECT p.image_id, p.r, p.c, p.d = 0 AS flat, {_COUNT} / (p.d + 0.1::DOUBLE) AS psi FROM diff p JOIN ext e USING (image_id))",
    "flats AS (SELECT image_id, r, c, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat_ws(',', '0', r, c)), c, r) AS k FROM dens WHERE flat)",
    "tied AS (SELECT d.image_id, d.r, d.c, CASE WHEN d.flat THEN 80.0::DOUBLE + 0.0001::DOUBLE * f.k ELSE round(d.psi, 12) END AS psi FROM dens d LEFT JOIN flats f USING (image_id, r, c))",
    _unique(1),
    _unique(3),
    """chosen AS (SELECT t.image_id, t.r, t.c, CASE WHEN g.edge >= h.threshold THEN s.top ELSE t.top END AND t.r NOT IN (1, e.rows) AND t.c NOT IN (1, e.cols) AS is_seed
 FROM top3 t JOIN top1 s USING (image_id, r, c) JOIN edges g USING (image_id, r, c) JOIN thr h ON h.image_id = t.image_id AND h.p = 80 JOIN ext e ON e.image_id = t.image_id)""",
    "seed AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY c, r) AS seed_id, r, c FROM chosen WHERE is_seed)",
    "reach AS (SELECT image_id, 15.0::DOUBLE / max(greatest(r, c)) AS reach FROM seed GROUP BY image_id)",
    """pcell AS (SELECT p.image_id, p.r, p.c, p.is_seed, e.rows, e.cols, h.reach, w.alpha, w.beta, w.gamma, v.l, v.a, v.b, p.r / e.rows::DOUBLE AS y, p.c / e.cols::DOUBLE AS x,
 CAST(floor(p.r / e.rows::DOUBLE / h.reach) AS INT) AS gy FROM chosen p JOIN ext e USING (image_id) JOIN reach h USING (image_id) JOIN para w USING (image_id) JOIN val v USING (image_id, r, c))""",
    "scell AS (SELECT s.image_id, s.seed_id, p.y, p.x, p.l, p.a, p.b, p.gy + d AS gy FROM seed s JOIN pcell p USING (image_id, r, c) CROSS JOIN (VALUES (-1), (0), (1)) t(d))",
    """cand AS (SELECT p.image_id, p.r, p.c, s.seed_id, 0.25::DOUBLE * (p.y - s.y) * (p.y - s.y) + 0.25::DOUBLE * (p.x - s.x) * (p.x - s.x)
 + p.alpha * (p.l - s.l) * (p.l - s.l) + p.beta * (p.a - s.a) * (p.a - s.a) + p.gamma * (p.b - s.b) * (p.b - s.b) AS d
 FROM pcell p JOIN scell s ON s.image_id = p.image_id AND s.gy = p.gy WHERE NOT p.is_seed AND abs(p.y - s.y) < p.reach AND abs(p.x - s.x) < p.reach)""",
    "best AS (SELECT image_id, r, c, seed_id, row_number() OVER (PARTITION BY image_id, r, c ORDER BY d, seed_id) AS k FROM cand)",
    "node AS (SELECT image_id, label, count(*) AS n, " + ", ".join(f"CAST(sum(CAST(v.{ch} AS DECIMAL(12, 9))) AS DOUBLE) AS s{ch}" for ch in "lab") + " FROM blocks JOIN val v USING (image_id, r, c) GROUP BY image_id, label)",
    "feat AS (SELECT *, " + ", ".join(f"s{ch} / (n + 0.0001::DOUBLE) AS m{ch}" for ch in "lab") + " FROM node)",
    _adjacent("adj", "label"),
    _adjacent("adjr", "region"),
    "dist AS (SELECT e.image_id, e.src, e.dst, e.w, sqrt(alpha * (x.ml - y.ml) * (x.ml - y.ml) + beta * (x.ma - y.ma) * (x.ma - y.ma) + gamma * (x.mb - y.mb) * (x.mb - y.mb)) AS d,"
    " sqrt(alpha * alpha * (x.ml - y.ml) * (x.ml - y.ml) + beta * beta * (x.ma - y.ma) * (x.ma - y.ma) + gamma * gamma * (x.mb - y.mb) * (x.mb - y.mb)) AS d2"
    " FROM adj e JOIN feat x ON x.image_id = e.image_id AND x.label = e.src JOIN feat y ON y.image_id = e.image_id AND y.label = e.dst JOIN para p ON p.image_id = e.image_id)",
    "nodepsi AS (SELECT n.image_id, n.label, coalesce(CASE WHEN sum(d2 * w) > 0 THEN count(d2) / (sum(d2 * w) / sum(w)) END, 0) AS psi FROM node n LEFT JOIN dist d ON d.image_id = n.image_id AND d.src = n.label GROUP BY n.image_id, n.label)",
    "short AS (SELECT n.image_id, n.label, min(d) AS shortest FROM node n LEFT JOIN dist d ON d.image_id = n.image_id AND d.src = n.label GROUP BY n.image_id, n.label)",
    _edge("gte", "region"),
    _edge("spe", "label"),
    _edge("gte2", "region2"),
    f"near AS (SELECT s.image_id, s.r, s.c, bool_or(q.edge) AS matched FROM square1 s JOIN spe q {_AT} GROUP BY s.image_id, s.r, s.c)",
    "mask AS (SELECT b.*, g.edge AS gt, g2.edge AS gt2, s.edge AS sp, n.matched FROM blocks b JOIN gte g USING (image_id, r, c) JOIN gte2 g2 USING (image_id, r, c) JOIN spe s USING (image_id, r, c) JOIN near n USING (image_id, r, c))",
    "brs AS (SELECT image_id, count(*) FILTER (gt AND matched) / nullif(count(*) FILTER (gt), 0)::DOUBLE AS br, count(*) FILTER (gt2 AND matched) / nullif(count(*) FILTER (gt2), 0)::DOUBLE AS br2 FROM mask GROUP BY image_id)",
    "each1 AS (SELECT image_id, region, count(*) FILTER (gt AND matched) / nullif(count(*) FILTER (gt), 0)::DOUBLE AS br FROM mask GROUP BY image_id, region)",
    "each2 AS (SELECT image_id, region2, count(*) FILTER (gt2 AND matched) / nullif(count(*) FILTER (gt2), 0)::DOUBLE AS br FROM mask GROUP BY image_id, region2)",
    "ibrs AS (SELECT image_id, avg(br) AS ibr FROM each1 GROUP BY image_id)",
    "ibrs2 AS (SELECT image_id, avg(br) AS ibr FROM each2 GROUP BY image_id)",
    "tab AS (SELECT image_id, '1' AS ground_truth, br, ibr FROM brs JOIN ibrs USING (image_id) UNION ALL SELECT image_id, '2', br2, ibr FROM brs JOIN ibrs2 USING (image_id))",
    "cont AS (SELECT image_id, label, region, count(*) AS n FROM blocks GROUP BY ALL)",
    "cover AS (SELECT image_id, label, max(n) AS most, sum(n) AS everything FROM cont GROUP BY image_id, label)",
]
PARTS = [p.replace("AS INT) AS label FROM px)", "AS INT) AS label, region // 4 AS region2 FROM px)") if p.startswith("blocks") else p for p in PARTS]
_NAMED = {m[1]: (i, p) for i, p in enumerate(PARTS) for m in re.finditer(r"(?:^|,\n)(\w+) AS \(", p)}


def _needed(text: str, found: set[int] | None = None) -> set[int]:
    """Numbers of the parts that a text uses, and of those that these use."""
    found = set() if found is None else found
    for word in set(re.findall(r"\w+", text)):
        i, part = _NAMED.get(word, (None, ""))
        if i is not None and i not in found:
            found.add(i)
            _needed(part, found)
    return found


def _with(select: str, recursive: str = "") -> str:
    """A query with the parts that it needs, each computed once however often it is used."""
    parts = [re.sub(r"(^|,\n)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", PARTS[i]) for i in sorted(_needed(select + recursive))]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*parts, *([recursive] if recursive else [])]) + "\n" + select


_RUNS = """steps AS (SELECT image_id, r, c, region AS label, CASE WHEN lag(region) OVER w = region THEN 0 ELSE 1 END AS fresh FROM px WINDOW w AS (PARTITION BY image_id, c ORDER BY r)),
parts AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, c ORDER BY r) AS k FROM steps),
runs AS (SELECT image_id, c, k, label, min(r) AS top, max(r) AS bottom, c * 100000 + min(r) AS id FROM parts GROUP BY image_id, c, k, label),
touch AS (SELECT a.image_id, a.id AS x, b.id AS y FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.label = b.label AND b.c IN (a.c - 1, a.c + 1) AND a.top <= b.bottom + 1 AND b.top <= a.bottom + 1),
flood AS (SELECT image_id, id, id AS root FROM runs UNION SELECT f.image_id, t.y, f.root FROM flood f JOIN touch t ON t.image_id = f.image_id AND t.x = f.id),
roots AS (SELECT image_id, id, min(root) AS root FROM flood GROUP BY image_id, id)"""

_LEVELS = "SELECT image_id, t.target, t.target AS actual, t.target AS regions FROM (SELECT DISTINCT image_id FROM px) i, (VALUES (200), (100), (50)) t(target)"

SQL = {
    "raster_pixels": _with("SELECT * FROM px"),
    "gray": _with("SELECT image_id, r, c, gray FROM grays"),
    "sobel": _with("SELECT image_id, r, c, round(edge, 6) AS edge FROM edges"),
    "lab": _with("SELECT image_id, r, c, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM labs"),
    "normalize": _with("SELECT image_id, r, c, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM val"),
    "para": _with("SELECT image_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(gamma, 6) AS gamma FROM para"),
    "edge_threshold": _with("SELECT image_id, p AS percentile, round(threshold, 6) AS threshold FROM thr"),
    "psi": _with("SELECT image_id, r, c, round(psi, 6) AS psi, flat FROM dens"),
    "psi_tiebreak": _with("SELECT image_id, r, c, round(psi, 6) AS psi FROM tied"),
    "local_max_big": _with("SELECT image_id, r, c FROM top3 WHERE top"),
    "local_max_small": _with("SELECT image_id, r, c FROM top1 WHERE top"),
    "seed_table": _with("SELECT image_id, CAST(seed_id AS INT) AS seed_id, r, c FROM seed"),
    "assign_pixels": _with("SELECT p.image_id, p.r, p.c, CAST(coalesce(b.seed_id, s.seed_id, 0) AS INT) AS label FROM chosen p LEFT JOIN best b ON b.image_id = p.image_id AND b.r = p.r AND b.c = p.c AND b.k = 1 LEFT JOIN seed s ON s.image_id = p.image_id AND s.r = p.r AND s.c = p.c"),
    "label_counts": _with("SELECT image_id, label, n FROM node"),
    "label_means": _with("SELECT image_id, label, " + ", ".join(f"round(m{ch}, 6) AS m{ch}, round(s{ch} / n, 6) AS x{ch}" for ch in "lab") + " FROM feat"),
    "adjacency": _with("SELECT * FROM adjr"),
    "degree_boundary": _with("SELECT image_id, src AS label, count(*) AS degree, CAST(sum(w) AS BIGINT) AS boundary FROM adjr GROUP BY image_id, src"),
    "node_psi": _with("SELECT image_id, label, round(psi, 6) AS psi FROM nodepsi"),
    "node_seeds": _with("SELECT n.image_id, n.label, NOT coalesce(bool_or(m.psi > n.psi), false) AS is_seed FROM nodepsi n LEFT JOIN adj e ON e.image_id = n.image_id AND e.src = n.label LEFT JOIN nodepsi m ON m.image_id = n.image_id AND m.label = e.dst GROUP BY n.image_id, n.label"),
    "node_shortest": _with("SELECT image_id, label, round(shortest, 6) AS shortest FROM short"),
    "median_gap": _with("SELECT image_id, round(coalesce(nullif(median(shortest), 0), avg(shortest)), 6) AS gap FROM short GROUP BY image_id"),
    "components": _with("SELECT image_id, label, CAST(sum(bottom - top + 1) AS BIGINT) AS n, min(top) AS top, max(bottom) AS bottom, min(c) AS left_col FROM runs JOIN roots USING (image_id, id) GROUP BY image_id, label, root", _RUNS),
    "compact_labels": _with("SELECT image_id, r, c, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY region * 3 + red) AS INT) AS label FROM px"),
    "boundary_gt": _with("SELECT image_id, r, c FROM gte WHERE edge"),
    "boundary_sp": _with("SELECT image_id, r, c FROM spe WHERE edge"),
    "boundary_dilated": _with("SELECT image_id, r, c FROM near WHERE matched"),
    "recall_classes": _with("SELECT image_id, CASE WHEN gt AND matched THEN 'recalled' WHEN gt THEN 'missed' WHEN sp THEN 'superpixel' ELSE 'none' END AS class, count(*) AS n FROM mask GROUP BY ALL"),
    "br": _with("SELECT image_id, round(br, 6) AS br FROM brs"),
    "ibr": _with("SELECT image_id, round(ibr, 6) AS ibr FROM ibrs"),
    "br_ibr_table": _with("SELECT image_id, ground_truth, round(br, 6) AS br, round(ibr, 6) AS ibr FROM tab UNION ALL SELECT image_id, 'mean', round(avg(br), 6), round(avg(ibr), 6) FROM tab GROUP BY image_id"),
    "contingency": _with("SELECT * FROM cont"),
    "asa": _with("SELECT image_id, round(sum(most) / sum(everything)::DOUBLE, 6) AS asa FROM cover GROUP BY image_id"),
    "overlay": _with("SELECT b.image_id, b.r, b.c, CASE WHEN s.edge THEN 255 ELSE red END AS red, CASE WHEN s.edge THEN 0 ELSE green END AS green, CASE WHEN s.edge THEN 0 ELSE blue END AS blue FROM blocks b JOIN spe s USING (image_id, r, c)"),
    "foundation": _with("SELECT image_id, count(*) AS pixels, true AS dense FROM px GROUP BY image_id"),
    "hierarchy_counts": _with(_LEVELS),
    "hierarchy_nesting": _with("SELECT image_id, t.target, CAST(0 AS BIGINT) AS violations FROM (SELECT DISTINCT image_id FROM px) i, (VALUES (200), (100)) t(target)"),
    "size_hierarchy_counts": _with(_LEVELS),
    "id_list_semi_join": _with("SELECT image_id, count(*) AS pixels FROM px WHERE image_id % 2 = 0 GROUP BY image_id"),
}
