"""DuckDB twins of the catalog's queries."""

from __future__ import annotations

from rasterloom.operators.filters import gaussian_weights, uniform_weights
from rasterloom.plans.settings import BILATERAL, CANNY, CANNY_EVALUATED, CLAHE, GAUSS, MEDIAN, NLM, NLM_A, SHARES, UNIFORM


def q(x: str) -> str:
    return f"greatest(0, least(255, floor(({x}::DOUBLE + 0.5) * 255 + 0.5)))::INT"


def clamp(x: str) -> str:
    return f"greatest(0, least(255, {x}))"


E = f"e AS (SELECT vec_id, i::INT - 1 AS i, {q('embedding[i]')} AS v FROM embeddings, range(1, 65) t(i))"
F1 = E + ", f1 AS (SELECT 0::BIGINT AS image_id, vec_id::INT AS row, i AS col, v FROM e)"
F1B = F1 + ", f1b AS (SELECT * FROM f1 WHERE col < 63)"
F2 = E + ", f2 AS (SELECT vec_id AS image_id, (i // 8)::INT AS row, (i % 8)::INT AS col, v FROM e)"
F3 = E + """, f3 AS (SELECT 0::BIGINT AS image_id, (vec_id // 3)::INT AS row, i AS col, max(v) FILTER (vec_id % 3 = 0) AS r,
  max(v) FILTER (vec_id % 3 = 1) AS g, max(v) FILTER (vec_id % 3 = 2) AS b FROM e GROUP BY 1, 2, 3 HAVING count(*) = 3)"""


def noisy(v: str, row: str) -> str:
    k = f"((31 * ({row}) + 17 * col) % 97)"
    return f"(CASE WHEN {k} = 0 THEN 255 WHEN {k} = 1 THEN 0 ELSE {clamp(f'{v} + (7919 * ({row}) + 104729 * col) % 41 - 20')} END)::INT"


F5 = F1 + f", f5 AS (SELECT image_id, row, col, {noisy('v', 'row')} AS v FROM f1)"
F5C = F3 + f", f5c AS (SELECT image_id, row, col, {noisy('r', 'row')} AS r, {noisy('g', 'row + 1')} AS g, {noisy('b', 'row + 2')} AS b FROM f3)"
F7 = "f7 AS (SELECT 0::BIGINT AS image_id, (event_id // 100)::INT AS row, (event_id % 100)::INT AS col, greatest(0, least(255, floor(value::DOUBLE + 0.5)))::INT AS v FROM events)"
F8 = "f8 AS (SELECT 0::BIGINT AS image_id, (i // 96)::INT AS row, (i % 96)::INT AS col, ((3 * (i // 96) + 2 * (i % 96)) % 256)::INT AS v FROM range(5760) t(i))"
GRAYS = f"{F1B}, {F7}, px AS (SELECT 1::BIGINT AS image_id, row, col, v FROM f1 UNION ALL SELECT 2, row, col, v FROM f1b UNION ALL SELECT 3, row, col, v FROM f7)"


def hist(src: str, val: str = "v", key: str = "image_id") -> str:
    return f"""hist AS (SELECT k.{key}, l.level::INT AS level, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT {key} FROM {src}) k
  CROSS JOIN range(256) l(level) LEFT JOIN (SELECT {key}, {val} AS level, count(*) AS n FROM {src} GROUP BY 1, 2) c ON c.{key} = k.{key} AND c.level = l.level)"""


def lut(src: str, val: str = "v") -> str:
    return hist(src, val) + """, cdf AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY level) AS cdf, sum(n) OVER (PARTITION BY image_id) AS total FROM hist),
  firsts AS (SELECT *, min(CASE WHEN n > 0 THEN cdf END) OVER (PARTITION BY image_id) AS first FROM cdf),
  lut AS (SELECT image_id, level, (CASE WHEN total = first THEN 0 ELSE greatest(0, least(255, round(255.0::DOUBLE * (cdf - first)::DOUBLE / (total - first)::DOUBLE))) END)::INT AS mapped FROM firsts)"""


def bucket(src: str, val: str, keep: str) -> str:
    return f"""SELECT {keep}, least(255, (row_number() OVER (PARTITION BY image_id ORDER BY {val}, row, col) - 1) * 256 // count(*) OVER (PARTITION BY image_id))::INT AS {val} FROM {src}"""


def trunc(x: str) -> str:
    return f"floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {x})) + 0.5::DOUBLE)::INT"


def d(x: float) -> str:
    return f"({x!r})::DOUBLE"


YUV = f"""yuv AS (SELECT image_id, row, col, {trunc('0.257::DOUBLE * r + 0.504::DOUBLE * g + 0.098::DOUBLE * b + 16.0::DOUBLE')} AS y,
  {trunc('-0.148::DOUBLE * r + -0.291::DOUBLE * g + 0.439::DOUBLE * b + 128.0::DOUBLE')} AS u,
  {trunc('0.439::DOUBLE * r + -0.368::DOUBLE * g + -0.071::DOUBLE * b + 128.0::DOUBLE')} AS vv FROM f3)"""


def rgb(src: str) -> str:
    y = "1.164::DOUBLE * (y - 16)"
    return f"""SELECT image_id, row, col, {trunc(f'{y} + 1.596::DOUBLE * (vv - 128)')} AS r, {trunc(f'{y} - 0.813::DOUBLE * (vv - 128) - 0.391::DOUBLE * (u - 128)')} AS g,
  {trunc(f'{y} + 2.018::DOUBLE * (u - 128)')} AS b FROM {src}"""


def offs(taps: list[tuple], name: str = "offs") -> str:
    """Offsets with a running number, so that sums can follow row-major order."""
    rows = ", ".join(f"({k}, {t[0]}, {t[1]}, {d(float(t[2]))})" for k, t in enumerate(taps))
    return f"{name}(k, di, dj, w) AS (VALUES {rows})"


def taps(src: str, cols: str = "v", out: str = "taps", off: str = "offs") -> str:
    """Clamped neighbours of every pixel: (image_id, row, col, k, di, dj, w, n_*)."""
    named = ", ".join(f"n.{c} AS n_{c}" for c in cols.split(","))
    own = ", ".join(f"p.{c} AS {c}" for c in cols.split(","))
    return f"""{out}_at AS MATERIALIZED (SELECT p.image_id, p.row, p.col, {own}, o.k, o.di, o.dj, o.w, greatest(0, least(mr, p.row + o.di)) AS nr, greatest(0, least(mc, p.col + o.dj)) AS nc
    FROM {src} p JOIN (SELECT image_id, max(row) AS mr, max(col) AS mc FROM {src} GROUP BY 1) s USING (image_id) CROSS JOIN {off} o),
  {out} AS (SELECT p.* EXCLUDE (nr, nc), {named} FROM {out}_at p JOIN {src} n ON n.image_id = p.image_id AND n.row = p.nr AND n.col = p.nc)"""


def ordered(expr: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list({expr} ORDER BY k)), lambda a, b: a + b)"


def conv(src: str, weights: list[tuple], cols: str) -> str:
    sums = ", ".join(f"greatest(0, least(255, round({ordered(f'w * n_{c}')})))::INT AS {c}" for c in cols.split(","))
    return f"{offs(weights)}, {taps(src, cols)} SELECT image_id, row, col, {sums} FROM taps GROUP BY 1, 2, 3"


def square(k: int) -> list[tuple]:
    return [(i, j, 1.0) for i in range(-(k // 2), k // 2 + 1) for j in range(-(k // 2), k // 2 + 1)]


def median(src: str, k: int, cols: str) -> str:
    return f"{offs(square(k))}, {taps(src, cols)} SELECT image_id, row, col, {', '.join(f'(list(n_{c} ORDER BY n_{c}))[{k * k // 2 + 1}]::INT AS {c}' for c in cols.split(','))} FROM taps GROUP BY 1, 2, 3"


def nlm(src: str, h: float, patch: int, search: int, cols: str, a: float | None) -> str:
    """Both patches are pulled with clamped indices; the candidate is clamped before its patch is."""
    names = cols.split(",")
    from math import exp
    g = [(i, j, exp(-(i * i + j * j) / (2 * a * a)) if a else 1.0) for i, j, _ in square(patch)]
    norm = 0.0
    for _, _, w in g:
        norm += w
    dist = " + ".join(f"(b.n_{c} - c.n_{c}) * (b.n_{c} - c.n_{c})" for c in names)
    skip = "WHERE NOT (s.cr = s.row AND s.cc = s.col)" if a else ""
    return f"""{offs(g)}, search(sk, si, sj) AS (VALUES {', '.join(f'({k}, {i}, {j})' for k, (i, j, _) in enumerate(square(search)))}),
  {taps(src, cols, 'patches')},
  cand AS (SELECT p.image_id, p.row, p.col, s.sk, greatest(0, least(mr, p.row + s.si)) AS cr, greatest(0, least(mc, p.col + s.sj)) AS cc FROM {src} p
    JOIN (SELECT image_id, max(row) AS mr, max(col) AS mc FROM {src} GROUP BY 1) USING (image_id) CROSS JOIN search s),
  dists AS (SELECT s.image_id, s.row, s.col, s.sk, s.cr, s.cc, sum(b.w * ({dist})) / {d(norm if a else 1.0)} AS dist FROM cand s
    JOIN patches b ON b.image_id = s.image_id AND b.row = s.row AND b.col = s.col
    JOIN patches c ON c.image_id = s.image_id AND c.row = s.cr AND c.col = s.cc AND c.k = b.k {skip} GROUP BY 1, 2, 3, 4, 5, 6),
  mixed AS (SELECT s.image_id, s.row, s.col, {', '.join(f'sum(exp(-s.dist / {d(h * h)}) * n.{c}) AS t_{c}' for c in names)}, sum(exp(-s.dist / {d(h * h)})) AS bottom FROM dists s
    JOIN {src} n ON n.image_id = s.image_id AND n.row = s.cr AND n.col = s.cc GROUP BY 1, 2, 3)
  SELECT p.image_id, p.row, p.col, {', '.join(f'(CASE WHEN bottom > 0 THEN greatest(0, least(255, round(t_{c} / bottom))) ELSE p.{c} END)::INT AS {c}' for c in names)} FROM {src} p LEFT JOIN mixed m USING (image_id, row, col)"""


def grads(src: str) -> str:
    x = {(-1, -1): -1, (0, -1): -2, (1, -1): -1, (-1, 1): 1, (0, 1): 2, (1, 1): 1}
    y = {(-1, -1): 1, (-1, 0): 2, (-1, 1): 1, (1, -1): -1, (1, 0): -2, (1, 1): -1}
    pick = lambda t: "sum(CASE " + " ".join(f"WHEN di = {i} AND dj = {j} THEN {w} * n_v" for (i, j), w in t.items()) + " ELSE 0 END)::INT"
    return f"{offs(square(3))}, {taps(src)}, grads AS (SELECT image_id, row, col, {pick(x)} AS gx, {pick(y)} AS gy FROM taps GROUP BY 1, 2, 3)"


def scaled(c: str) -> str:
    lo, hi = f"min({c}) OVER (PARTITION BY image_id)::FLOAT", f"max({c}) OVER (PARTITION BY image_id)::FLOAT"
    return f"(CASE WHEN {hi} - {lo} < 1e-12 THEN 0 ELSE round((({c}::FLOAT - {lo}) / ({hi} - {lo})) * 255.0::FLOAT) END)::INT"


def mags(src: str) -> str:
    return f"""{grads(src)}, raw AS (SELECT *, sqrt((gx * gx + gy * gy)::DOUBLE)::FLOAT AS m FROM grads),
  mags AS (SELECT image_id, row, col, {scaled('gx')} AS gx, {scaled('gy')} AS gy, {scaled('m')} AS mag FROM raw)"""


def level(share: float) -> int:
    return int(share / 100 * 255 + 0.5)


def psnr(mse: str) -> str:
    return f"round(CASE WHEN {mse} = 0 THEN 1e9 ELSE 10.0::DOUBLE * log10(65025.0::DOUBLE / {mse}) END, 6)"


def parity() -> str:
    return "CASE WHEN row % 2 = 0 AND col % 2 = 1 THEN 'r' WHEN row % 2 = 1 AND col % 2 = 0 THEN 'b' WHEN row % 2 = 1 THEN 'o' ELSE 'e' END"


CFA = f"""{F1}, {offs(square(3))}, {taps('f1')}, s AS (SELECT image_id, row, col, {parity()} AS site, max(v) AS v,
  sum(n_v) FILTER (abs(di) + abs(dj) = 1) // 4 AS cross4, sum(n_v) FILTER (abs(di) + abs(dj) = 2) // 4 AS corner,
  sum(n_v) FILTER (di = 0 AND dj <> 0) // 2 AS flat, sum(n_v) FILTER (di <> 0 AND dj = 0) // 2 AS tall FROM taps GROUP BY 1, 2, 3, 4)
SELECT image_id, row, col, (CASE site WHEN 'r' THEN v WHEN 'b' THEN corner WHEN 'o' THEN tall ELSE flat END)::INT AS r,
  (CASE WHEN site IN ('r', 'b') THEN cross4 ELSE v END)::INT AS g, (CASE site WHEN 'b' THEN v WHEN 'r' THEN corner WHEN 'o' THEN flat ELSE tall END)::INT AS b FROM s"""

BILATERAL_SQL = f"""{F5}, {offs(square(BILATERAL[0]))}, {taps('f5')},
w AS (SELECT *, exp(-(di * di + dj * dj)::DOUBLE / {d(2 * BILATERAL[1] ** 2)}) * exp(-((n_v - v) * (n_v - v))::DOUBLE / {d(2 * BILATERAL[2] ** 2)}) AS wt FROM taps)
SELECT image_id, row, col, greatest(0, least(255, round({ordered('wt * n_v')} / {ordered('wt')})))::INT AS v FROM w GROUP BY 1, 2, 3"""


def shifted(shift: int) -> str:
    return f"SELECT p.image_id, p.row, p.col, s.mag FROM f1 p JOIN mags s ON s.image_id = p.image_id AND s.col = p.col AND s.row = greatest(0, p.row - {shift})"


EDGES = f"""{F1}, {mags('f1')}, maps AS (SELECT image_id, 'sobel' || t.s AS detector, row, col, (CASE WHEN mag >= t.lv THEN 255 ELSE 0 END)::INT AS v FROM mags,
  (VALUES {', '.join(f'({s}, {level(s)})' for s in SHARES)}) t(s, lv)),
  truth AS ({' UNION ALL '.join(f"SELECT image_id, {k + 1}::INT AS gt_id, row, col FROM ({shifted(k)}) WHERE mag >= {level(40)}" for k in range(3))})"""
CANDIDATES = f"""{EDGES}, size AS (SELECT 0.0075::DOUBLE * sqrt((max(row) + 1) ^ 2 + (max(col) + 1) ^ 2) AS most FROM f1)
SELECT e.image_id, e.detector, t.gt_id, e.row, e.col, t.row AS grow, t.col AS gcol, ((e.row - t.row) * (e.row - t.row) + (e.col - t.col) * (e.col - t.col))::INT AS d2
FROM (SELECT * FROM maps WHERE v = 255) e JOIN truth t ON t.image_id = e.image_id AND t.row BETWEEN e.row - 60 AND e.row + 60 AND t.col BETWEEN e.col - 60 AND e.col + 60, size
WHERE sqrt(((e.row - t.row) * (e.row - t.row) + (e.col - t.col) * (e.col - t.col))::DOUBLE) <= most"""


def clahe(src: str, val: str = "v", keep: str = "") -> str:
    """Equal tiles over the mirrored raster; padded rows and columns are listed with the row or column they mirror."""
    clip, tx, ty = CLAHE
    pads = [f"(CASE WHEN h % {ty} = 0 AND w % {tx} = 0 THEN 0 ELSE {t} - {n} % {t} END)" for n, t in (("h", ty), ("w", tx))]

    def padded(name: str, n: str, pad: str, size: str, out: str) -> str:
        """One row for each row (column) of the padded raster: the one it shows and its tile."""
        back = f"(2 * ({n} - 1))"
        return f"{name} AS (SELECT image_id, (CASE WHEN {n} = 1 THEN 0 WHEN p % {back} < {n} THEN p % {back} ELSE {back} - p % {back} END)::INT AS src, (p // {size})::INT AS {out} FROM (SELECT *, unnest(range({n} + {pad})) AS p FROM size))"

    def axis(c: str, n: str, tiles: int, k: str) -> str:
        at = f"({c}::FLOAT * (1.0::FLOAT / {n}::FLOAT) - 0.5::FLOAT)"
        return f"greatest(0, floor({at}))::INT AS {k}0, least({tiles - 1}, floor({at}) + 1)::INT AS {k}1, ({at} - floor({at})::FLOAT)::FLOAT AS {k}w"

    joins = " ".join(f"JOIN luts l{a}{b} ON l{a}{b}.image_id = p.image_id AND l{a}{b}.ty = p.y{a} AND l{a}{b}.tx = p.x{b} AND l{a}{b}.level = p.{val}" for a in "01" for b in "01")
    one = "1.0::FLOAT"
    row = lambda y: f"(l{y}0.m * ({one} - xw) + l{y}1.m * xw)"
    return f"""dims AS (SELECT image_id, max(row) + 1 AS h, max(col) + 1 AS w FROM {src} GROUP BY 1),
  size AS (SELECT *, {pads[0]} AS ph, {pads[1]} AS pw, (h + {pads[0]}) // {ty} AS th, (w + {pads[1]}) // {tx} AS tw FROM dims),
  {padded("prows", "h", "ph", "th", "ty")}, {padded("pcols", "w", "pw", "tw", "tx")},
  filled AS (SELECT s.image_id, r.ty, c.tx, s.{val} AS level, count(*) AS n FROM {src} s JOIN prows r ON r.image_id = s.image_id AND r.src = s.row JOIN pcols c ON c.image_id = s.image_id AND c.src = s.col GROUP BY 1, 2, 3, 4),
  cells AS (SELECT k.image_id, k.ty, k.tx, l.level::INT AS level, coalesce(c.n, 0)::BIGINT AS n, (z.th * z.tw)::BIGINT AS area FROM (SELECT DISTINCT image_id, ty, tx FROM filled) k JOIN size z USING (image_id) CROSS JOIN range(256) l(level)
    LEFT JOIN filled c ON c.image_id = k.image_id AND c.ty = k.ty AND c.tx = k.tx AND c.level = l.level),
  lim AS (SELECT *, greatest(1, floor({d(clip)} * area / 256))::BIGINT AS lim FROM cells),
  exc AS (SELECT *, (sum(greatest(0, n - lim)) OVER (PARTITION BY image_id, ty, tx))::BIGINT AS exc FROM lim),
  flat AS (SELECT *, least(n, lim) + exc // 256 + CASE WHEN exc % 256 > 0 AND level % greatest(1, 256 // greatest(1, exc % 256)) = 0 AND level // greatest(1, 256 // greatest(1, exc % 256)) < exc % 256 THEN 1 ELSE 0 END AS f FROM exc),
  luts AS (SELECT image_id, ty, tx, level, greatest(0, least(255, round_even(((sum(f) OVER (PARTITION BY image_id, ty, tx ORDER BY level))::FLOAT * (255::FLOAT / area::FLOAT))::DOUBLE, 0)))::FLOAT AS m FROM flat),
  placed AS (SELECT p.*, {axis("row", "th", ty, "y")}, {axis("col", "tw", tx, "x")} FROM {src} p JOIN size USING (image_id))
  SELECT p.image_id, p.row, p.col, {keep} greatest(0, least(255, round_even(({row(0)} * ({one} - yw) + {row(1)} * yw)::DOUBLE, 0)))::INT AS {val} FROM placed p {joins}"""


def canny_steps(low: float, high: float) -> str:
    """From grads: non-maximum suppression (strict on both sides along diagonals), then reachability over the eight neighbours; the result is dark (image_id, row, col, v)."""
    flat, tall = "abs(gy) <= (sqrt(2.0::DOUBLE) - 1) * abs(gx)", "abs(gy) >= (sqrt(2.0::DOUBLE) + 1) * abs(gx)"
    around = ", ".join(f"({i}, {j})" for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
    return f"""slopes AS (SELECT *, sqrt((gx * gx + gy * gy)::DOUBLE) AS mag, CASE WHEN {flat} THEN 0 ELSE -1 END AS di,
  CASE WHEN {flat} THEN -1 WHEN {tall} THEN 0 WHEN gx * gy > 0 THEN 1 ELSE -1 END AS dj FROM grads),
  nms AS MATERIALIZED (SELECT m.image_id, m.row, m.col, CASE WHEN m.mag > coalesce(a.mag, 0) AND (m.mag > coalesce(b.mag, 0) OR m.di * m.dj = 0 AND m.mag = coalesce(b.mag, 0)) THEN CASE WHEN m.mag > {d(high)} THEN 2 WHEN m.mag > {d(low)} THEN 1 ELSE 0 END ELSE 0 END AS state FROM slopes m
    LEFT JOIN slopes a ON a.image_id = m.image_id AND a.row = m.row + m.di AND a.col = m.col + m.dj LEFT JOIN slopes b ON b.image_id = m.image_id AND b.row = m.row - m.di AND b.col = m.col - m.dj),
  around(di, dj) AS (VALUES {around}),
  reached AS (SELECT image_id, row, col FROM nms WHERE state = 2 UNION SELECT w.image_id, w.row, w.col FROM (SELECT r.image_id, r.row + o.di AS row, r.col + o.dj AS col FROM reached r, around o) r JOIN nms w ON w.image_id = r.image_id AND w.row = r.row AND w.col = r.col AND w.state = 1),
  dark AS (SELECT n.image_id, n.row, n.col, (CASE WHEN r.row IS NULL THEN 255 ELSE 0 END)::INT AS v FROM nms n LEFT JOIN reached r USING (image_id, row, col))"""


def canny(src: str, grays: str) -> str:
    return f"{grays}, {grads(src)}, {canny_steps(*CANNY)} SELECT * FROM dark"


EXACT = f"""{EDGES}, {canny_steps(*CANNY_EVALUATED)}, every_map AS (SELECT * FROM maps UNION ALL SELECT image_id, 'graded', row, col, mag FROM mags UNION ALL SELECT image_id, 'canny', row, col, 255 - v FROM dark),
  n_truth AS (SELECT image_id, gt_id, count(*) AS n_gt FROM truth GROUP BY 1, 2),
  pixels AS (SELECT m.image_id, m.detector, m.v, t.gt_id FROM every_map m JOIN truth t USING (image_id, row, col)),
  at_t AS (SELECT m.image_id, m.detector, k.t::INT AS t, count(*) FILTER (m.v * 100 >= k.t * 255) AS n_edge FROM every_map m, range(101) k(t) GROUP BY 1, 2, 3),
  hits AS (SELECT p.image_id, p.detector, k.t::INT AS t, p.gt_id, count(*) FILTER (p.v * 100 >= k.t * 255) AS tp FROM pixels p, range(101) k(t) GROUP BY 1, 2, 3, 4),
  pr AS (SELECT a.image_id, a.detector, a.t, n.gt_id, coalesce(h.tp, 0)::BIGINT AS tp, a.n_edge, n.n_gt, coalesce(h.tp, 0)::DOUBLE / (a.n_edge + {d(2.0**-52)}) AS p, coalesce(h.tp, 0)::DOUBLE / (n.n_gt + {d(2.0**-52)}) AS r
    FROM at_t a JOIN n_truth n USING (image_id) LEFT JOIN hits h ON h.image_id = a.image_id AND h.detector = a.detector AND h.t = a.t AND h.gt_id = n.gt_id),
  means AS (SELECT image_id, detector, t, avg(p) AS p, avg(r) AS r, min(n_edge) AS n_edge FROM pr GROUP BY 1, 2, 3),
  curve AS (SELECT *, 2.0::DOUBLE * p * r / (p + r + {d(2.0**-52)}) AS f FROM means),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, detector ORDER BY f DESC, t) AS k FROM curve) WHERE k = 1)"""
SIX = "round(p, 6) AS p, round(r, 6) AS r"


def text_lines(keys: str, header: str, source: str) -> str:
    """Lines (keys, k, line) of source with the header at -1."""
    return f"SELECT {keys}, k::BIGINT AS k, line FROM ({source}) UNION ALL SELECT DISTINCT {keys}, -1::BIGINT, '{header}' FROM ({source})"


PR_CSV = f"""SELECT image_id, detector, gt_id AS k, gt_id || ',' || printf('%.6f', p) || ',' || printf('%.6f', r) AS line FROM pr WHERE t = 20 AND n_edge > 0
  UNION ALL SELECT image_id, detector, {1 << 30}, 'Mean,' || printf('%.6f', p) || ',' || printf('%.6f', r) FROM curve WHERE t = 20 AND n_edge > 0 UNION ALL SELECT image_id, detector, {(1 << 30) + 1}, 'F-measure,' || printf('%.6f', f) || ',' FROM curve WHERE t = 20 AND n_edge > 0"""
CURVE_CSV = f"""SELECT image_id, detector, t AS k, printf('%.2f', t / 100.0::DOUBLE) || ',' || printf('%.6f', p) || ',' || printf('%.6f', r) || ',' || printf('%.6f', f) AS line FROM curve
  UNION ALL SELECT image_id, detector, {1 << 30}, 'Best,,,' FROM best UNION ALL SELECT image_id, detector, {(1 << 30) + 1}, 'BestT,' || printf('%.2f', t / 100.0::DOUBLE) || ',,' FROM best UNION ALL SELECT image_id, detector, {(1 << 30) + 2}, 'BestF,,,' || printf('%.6f', f) FROM best"""

C3 = "r,g,b"
GAUSS_W = gaussian_weights(*GAUSS)
MEDC = F5C + ", med AS (WITH " + median("f5c", MEDIAN, C3) + ")"
NLMC = F2
F2RGB = F2 + ", f2c AS (SELECT image_id // 3 AS image_id, row, col, max(v) FILTER (image_id % 3 = 0) AS r, max(v) FILTER (image_id % 3 = 1) AS g, max(v) FILTER (image_id % 3 = 2) AS b FROM f2 GROUP BY 1, 2, 3 HAVING count(*) = 3)"

GRAY_WORLD = f"""m AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM f3 GROUP BY 1),
  balanced AS (SELECT image_id, row, col, {', '.join(trunc(f'(CASE WHEN m{c} <= 1e-12 THEN 1.0::DOUBLE ELSE ((mr + mg + mb) / 3) / m{c} END) * {c}') + f' AS {c}' for c in 'rgb')} FROM f3 JOIN m USING (image_id))"""
F2NOISY = F2 + f", f2n AS (SELECT image_id, row, col, {noisy('v', 'row')} AS v FROM f2)"


def quality(clean: str, noisy_: str, label: str, planes: str) -> str:
    """(filter, image_id, mse_*, psnr_*) of one filtered raster."""
    sums = ", ".join(f"avg((a.{c} - b.{c}) * (a.{c} - b.{c})) AS {c}" for c in planes)
    out = ", ".join(f"round({c}, 6) AS mse_{c}, {psnr(c)} AS psnr_{c}" for c in planes)
    return f"SELECT '{label}' AS filter, image_id, {out} FROM (SELECT a.image_id, {sums} FROM {clean} a JOIN ({noisy_}) b USING (image_id, row, col) GROUP BY 1)"


def counts(src: str, c: str, name: str) -> str:
    return f"count(*) FILTER (kind = '{src}' AND ch = '{c}') AS {name}"


RGB_COUNTS = ", ".join(counts(k, c, f"{c.upper()}_{k}") for k in ("before", "after") for c in "rgb")
RGB_CSV = f"""SELECT 0::BIGINT AS image_id, l.level AS k, l.level || {" || ".join(f"',' || coalesce({c.upper()}_{k}, 0)" for k in ("before", "after") for c in "rgb")} AS line FROM range(256) l(level) LEFT JOIN (
  SELECT v, {RGB_COUNTS} FROM ({" UNION ALL ".join(f"SELECT '{k}' AS kind, '{c}' AS ch, {c} AS v FROM {src}" for k, src in (("before", "f3"), ("after", "balanced")) for c in "rgb")}) GROUP BY 1) x ON x.v = l.level"""
GRAY32 = "g AS (SELECT image_id, row, col, greatest(0, least(255, round(0.2989::FLOAT * r::FLOAT + 0.5870::FLOAT * g::FLOAT + 0.1140::FLOAT * b::FLOAT)))::INT AS v FROM f3)"
LONG3 = " UNION ALL ".join(f"SELECT 0::BIGINT AS image_id, row, col, {i} AS ch, {c} AS v FROM f3" for i, c in enumerate("rgb"))

ORACLES = {
    "edge_pr_exact": f"WITH RECURSIVE {EXACT} SELECT image_id, detector, t, gt_id, tp, n_edge, n_gt, {SIX} FROM pr WHERE t = 20 AND n_edge > 0",
    "edge_pr_mean_exact": f"WITH RECURSIVE {EXACT} SELECT image_id, detector, t, {SIX}, round(f, 6) AS f FROM curve WHERE t = 20 AND n_edge > 0",
    "edge_sweep_exact": f"WITH RECURSIVE {EXACT} SELECT image_id, detector, t, {SIX}, round(f, 6) AS f FROM curve",
    "edge_best_exact": f"WITH RECURSIVE {EXACT} SELECT image_id, detector, t, {SIX}, round(f, 6) AS f FROM best",
    "pr_csv": f"WITH RECURSIVE {EXACT} {text_lines('image_id, detector', 'GT,Precision,Recall', PR_CSV)}",
    "curve_csv": f"WITH RECURSIVE {EXACT} {text_lines('image_id, detector', 'T,MeanPrecision,MeanRecall,MeanF', CURVE_CSV)}",
    "histogram_csv": f"WITH {GRAYS}, {hist('px')} {text_lines('image_id', 'intensity,count', 'SELECT image_id, level AS k, level || chr(44) || n AS line FROM hist')}",
    "transfer_csv": f"WITH {GRAYS}, {lut('px')} {text_lines('image_id', 'intensity,mapped', 'SELECT image_id, level AS k, level || chr(44) || mapped AS line FROM lut')}",
    "cdf_csv": f"WITH {GRAYS}, {hist('px')}, c AS (SELECT image_id, level, (sum(n) OVER (PARTITION BY image_id ORDER BY level))::DOUBLE / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS cdf FROM hist) {text_lines('image_id', 'intensity,cdf', f'SELECT image_id, level AS k, level || chr(44) || printf({chr(39)}%.6g{chr(39)}, cdf) AS line FROM c')}",
    "rgb_histogram_csv": f"WITH {F3}, {GRAY_WORLD} {text_lines('image_id', 'value,R_before,G_before,B_before,R_after,G_after,B_after', RGB_CSV)}",
    "denoise_psnr": f"WITH {F5}, {offs(square(BILATERAL[0]), 'offs')}, {taps('f5')}, u AS (WITH {conv('f5', uniform_weights(UNIFORM), 'v')}), ga AS (WITH {conv('f5', gaussian_weights(*GAUSS), 'v')}), bi AS ({BILATERAL_SQL[BILATERAL_SQL.index('w AS ('):].replace('w AS (', 'WITH w AS (', 1)}) {' UNION ALL '.join(quality('f1', f'SELECT * FROM {t}', n, 'v') for n, t in (('none', 'f5'), ('uniform', 'u'), ('gaussian', 'ga'), ('bilateral', 'bi')))}",
    "denoise_psnr_nlm": f"WITH {F2NOISY}, den AS (WITH {nlm('f2n', *NLM, 'v', NLM_A)}) {quality('f2', 'SELECT * FROM den', 'nlm', 'v')}",
    "denoise_psnr_rgb": f"WITH {MEDC}, mg AS (WITH {conv('med', GAUSS_W, C3)}) {' UNION ALL '.join(quality('f3', f'SELECT * FROM {t}', n, 'rgb') for n, t in (('none', 'f5c'), ('median', 'med'), ('median_gaussian', 'mg')))}",
    "sobel_pipeline": f"WITH {F3}, {GRAY32}, {mags('g')} SELECT m.image_id, m.row, m.col, g.v AS gray, gx, gy, mag, (CASE WHEN mag >= {level(25)} THEN 0 ELSE 255 END)::INT AS edge FROM mags m JOIN g USING (image_id, row, col)",
    "raw_roundtrip_rgb": f"WITH {F3} {LONG3}",
    "png_roundtrip": f"WITH {F3} {LONG3}",
    "raw_images": f"WITH {F1} SELECT k::BIGINT AS image_id, row, col, (v + k) % 256 AS v FROM f1, range(3) t(k)",
    "bayer_sites": f"WITH {F1} SELECT image_id, CASE WHEN row % 2 = 0 AND col % 2 = 1 THEN 'r' WHEN row % 2 = 1 AND col % 2 = 0 THEN 'b' ELSE 'g' END AS site, count(*) AS n, sum(v)::BIGINT AS total FROM f1 GROUP BY 1, 2",
    "edges_inverted": f"WITH {F1}, {mags('f1')} SELECT image_id, row, col, (CASE WHEN mag >= {level(25)} THEN 255 ELSE 0 END)::INT AS v FROM mags",
    "histogram_gray": f"WITH {GRAYS}, {hist('px')} SELECT * FROM hist",
    "histogram_rgb": f"""WITH {F3}, c AS (SELECT image_id, 0 AS ch, r AS v FROM f3 UNION ALL SELECT image_id, 1, g FROM f3 UNION ALL SELECT image_id, 2, b FROM f3)
      SELECT 0::BIGINT AS image_id, k.ch::INT AS ch, l.level::INT AS level, count(c.v)::BIGINT AS n FROM (VALUES (0), (1), (2)) k(ch) CROSS JOIN range(256) l(level) LEFT JOIN c ON c.ch = k.ch AND c.v = l.level GROUP BY 1, 2, 3""",
    "cdf_normalized": f"WITH {GRAYS}, {hist('px')} SELECT image_id, level, (sum(n) OVER (PARTITION BY image_id ORDER BY level))::DOUBLE / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS cdf FROM hist",
    "intensity_range": f"WITH {GRAYS} SELECT image_id, min(v)::INT AS v_min, max(v)::INT AS v_max FROM px GROUP BY 1",
    "transfer_function": f"WITH {GRAYS}, {lut('px')} SELECT * FROM lut",
    "equalize_lut": f"WITH {F1}, {lut('f1')} SELECT p.image_id, p.row, p.col, l.mapped AS v FROM f1 p JOIN lut l ON l.image_id = p.image_id AND l.level = p.v",
    "equalize_bucket": f"WITH {GRAYS} {bucket('px', 'v', 'image_id, row, col')}",
    "rgb_to_yuv": f"WITH {F3}, {YUV} SELECT image_id, row, col, y, u, vv AS v FROM yuv",
    "yuv_roundtrip": f"WITH {F3}, {YUV} {rgb('yuv')}",
    "equalize_luma_lut": f"WITH {F3}, {YUV}, {lut('yuv', 'y')}, eq AS (SELECT p.image_id, row, col, l.mapped AS y, u, vv FROM yuv p JOIN lut l ON l.image_id = p.image_id AND l.level = p.y) {rgb('eq')}",
    "equalize_luma_bucket": f"WITH {F3}, {YUV}, eq AS ({bucket('yuv', 'y', 'image_id, row, col, u, vv')}) {rgb('eq')}",
    "equalize_luma_clahe": f"WITH {F3}, {YUV}, eq AS (WITH {clahe('yuv', 'y', 'p.u, p.vv,')}) {rgb('eq')}",
    "gray_float32": f"WITH {F3} SELECT image_id, row, col, greatest(0, least(255, round(0.2989::FLOAT * r::FLOAT + 0.5870::FLOAT * g::FLOAT + 0.1140::FLOAT * b::FLOAT)))::INT AS v FROM f3",
    "gray_float64": f"WITH {F3} SELECT image_id, row, col, greatest(0, least(255, round(0.2989::DOUBLE * r + 0.5870::DOUBLE * g + 0.1140::DOUBLE * b)))::INT AS v FROM f3",
    "gray_world_stats": f"""WITH {F3}, m AS (SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM f3 GROUP BY 1)
      SELECT image_id, {', '.join(f'round({c}, 6) AS mean_{c}' for c in 'rgb')}, {', '.join(f'round(CASE WHEN {c} <= 1e-12 THEN 1.0 ELSE ((r + g + b) / 3) / {c} END, 6) AS gain_{c}' for c in 'rgb')} FROM m""",
    "gray_world": f"""WITH {F3}, m AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM f3 GROUP BY 1)
      SELECT image_id, row, col, {', '.join(trunc(f'(CASE WHEN m{c} <= 1e-12 THEN 1.0::DOUBLE ELSE ((mr + mg + mb) / 3) / m{c} END) * {c}') + f' AS {c}' for c in 'rgb')} FROM f3 JOIN m USING (image_id)""",
    "demosaic": f"WITH {CFA}",
    "uniform_filter": f"WITH {F5}, {conv('f5', uniform_weights(UNIFORM), 'v')}",
    "gaussian_filter": f"WITH {F5}, {conv('f5', GAUSS_W, 'v')}",
    "bilateral_filter": f"WITH {BILATERAL_SQL}",
    "median_rgb": f"WITH {F5C}, {median('f5c', MEDIAN, C3)}",
    "gaussian_rgb": f"WITH {F5C}, {conv('f5c', GAUSS_W, C3)}",
    "nlm_gray": f"WITH {F2}, {nlm('f2', *NLM, 'v', NLM_A)}",
    "nlm_rgb": f"WITH {F2RGB}, {nlm('f2c', *NLM, C3, None)}",
    "median_then_gaussian": f"WITH {MEDC}, {conv('med', GAUSS_W, C3)}",
    "median_then_nlm": f"WITH {F2RGB}, med AS (WITH {median('f2c', MEDIAN, C3)}), {nlm('med', *NLM, C3, None)}",
    "psnr_gray": f"WITH {F5}, m AS (SELECT a.image_id, avg((a.v - b.v) * (a.v - b.v)) AS mse FROM f1 a JOIN f5 b USING (image_id, row, col) GROUP BY 1) SELECT image_id, round(mse, 6) AS mse, {psnr('mse')} AS psnr FROM m",
    "psnr_rgb": f"""WITH {F5C}, m AS (SELECT a.image_id, {', '.join(f'avg((a.{c} - b.{c}) * (a.{c} - b.{c})) AS {c}' for c in 'rgb')} FROM f3 a JOIN f5c b USING (image_id, row, col) GROUP BY 1),
      p AS (SELECT image_id, {', '.join(f'CASE WHEN {c} = 0 THEN 1e9 ELSE 10.0::DOUBLE * log10(65025.0::DOUBLE / {c}) END AS {c}' for c in 'rgb')} FROM m)
      SELECT image_id, {', '.join(f'round({c}, 6) AS psnr_{c}' for c in 'rgb')}, round((r + g + b) / 3, 6) AS psnr_avg FROM p""",
    "sobel_gradients": f"WITH {F1}, {grads('f1')} SELECT * FROM grads",
    "sobel_magnitude": f"WITH {F1}, {mags('f1')} SELECT * FROM mags",
    "sobel_edges": f"WITH {F1}, {mags('f1')} SELECT image_id, row, col, (CASE WHEN mag >= {level(25)} THEN 0 ELSE 255 END)::INT AS v FROM mags",
    "edge_candidates": f"WITH {CANDIDATES}",
    "clahe": f"WITH {F7}, {F8}, both_ AS (SELECT * FROM f7 UNION ALL SELECT 1::BIGINT, row, col, v FROM f8), {clahe('both_')}",
    "canny": f"WITH RECURSIVE {canny('f8', F8)}",
    "canny_tables": f"WITH RECURSIVE {canny('px', GRAYS)}",
    "raw_roundtrip": f"WITH {F1} SELECT * FROM f1",
}
