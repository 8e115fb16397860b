"""DuckDB SQL for the raster queries, written from the definitions: neighbourhoods are joins with offsets."""

from __future__ import annotations
import math

EVENTS = """px AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, 100 AS w,
  CAST((SELECT max(event_id) FROM events) // 100 + 1 AS INT) AS h, CAST(floor(value) % 256 AS DOUBLE) AS c0, CAST(user_id % 256 AS DOUBLE) AS c1,
  CAST(event_id * 7 % 256 AS DOUBLE) AS c2, CAST(255 AS DOUBLE) AS c3 FROM events)"""
VECTORS = """px AS (SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, 8 AS w, CAST(n // 8 AS INT) AS h, CAST(embedding[i + 1] AS DOUBLE) AS c0
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM embeddings))"""
LUMA = "(0.299 * c0 + 0.587 * c1 + 0.114 * c2)"
RGB, RGBA = ("c0", "c1", "c2"), ("c0", "c1", "c2", "c3")


def clamp(v: str, low: float, high: float) -> str:
    return f"greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), {v}))"


def whole(v: str) -> str:
    return f"floor(round({clamp(v, 0, 255)}, 9))"


def half(v: str) -> str:
    return f"(CASE WHEN {v} = 0 OR abs({v}) < 0.00006103515625 THEN 0.0 WHEN abs({v}) >= 65504 THEN sign({v}) * 65504.0 ELSE sign({v}) * floor(abs({v}) / pow(2.0, floor(log2(abs({v}))) - 10)) * pow(2.0, floor(log2(abs({v}))) - 10) END)"


def near(name: str, source: str, k: int | str, columns: tuple[str, ...], more: str = "") -> str:
    """CTE: each pixel with its neighbours' columns at (dx, dy), edge values beyond the image."""
    offsets = f"(SELECT dx, dy FROM range(-{k}, {k} + 1) a(dx), range(-{k}, {k} + 1) b(dy))"
    return f"""{name}_at AS MATERIALIZED (SELECT p.*, dx, dy, greatest(0, least(w - 1, x + dx)) AS qx, greatest(0, least(h - 1, y + dy)) AS qy FROM {source} p CROSS JOIN {offsets} o),
{name} AS (SELECT p.image_id, p.x, p.y, dx, dy, {', '.join(f'q.{c} AS {c}' for c in columns)}{more}
  FROM {name}_at p JOIN {source} q ON q.image_id = p.image_id AND q.x = qx AND q.y = qy)"""


def inside(name: str, source: str, k: int, value: str) -> str:
    """CTE: mean, sd, least and most of a value in the window, which shrinks at borders."""
    return f"""{name} AS (SELECT p.image_id, p.x, p.y, avg(v) AS mean, sqrt(greatest(0, avg(v * v) - avg(v) * avg(v))) AS sd, min(v) AS lo, max(v) AS hi
  FROM {source} p JOIN (SELECT image_id, x, y, {value} AS v FROM {source}) q ON q.image_id = p.image_id AND q.x BETWEEN p.x - {k} AND p.x + {k} AND q.y BETWEEN p.y - {k} AND p.y + {k}
  GROUP BY p.image_id, p.x, p.y)"""


def out(body: str, columns: dict[str, str], source: str) -> str:
    return f"WITH {body}\nSELECT image_id, x, y, {', '.join(f'round({e}, 6) AS {c}' for c, e in columns.items())} FROM {source}"


def mask(body: str, t: str, source: str, value: str = LUMA) -> str:
    return f"WITH {body}\nSELECT image_id, x, y, CAST({value} > {t} AS DOUBLE) AS c0 FROM {source}"


def _basic() -> str:
    """The steps one after another, each a CTE, for the parameters of the query."""
    lum, smooth = "(0.2126 * r + 0.7152 * g + 0.0722 * b)", lambda v, a, z: f"(pow({clamp(f'({v} - {a}) / ({z} - {a})', 0, 1)}, 2) * (3 - 2 * {clamp(f'({v} - {a}) / ({z} - {a})', 0, 1)}))"
    size = 0.2126 * 1.015 + 0.7152 * 0.97 + 0.0722 * 1.015
    gain = {"r": 1.015 / size, "g": 0.97 / size, "b": 1.015 / size}
    decode = lambda c: f"(CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END)"
    encode = lambda c: f"(CASE WHEN {clamp(c, 0, 1)} <= 0.0031308 THEN {clamp(c, 0, 1)} * 12.92 ELSE pow({clamp(c, 0, 1)}, 1 / 2.4) * 1.055 - 0.055 END)"
    ctes, last = [EVENTS], "px"

    def step(values: dict[str, str], more: str = "") -> None:
        nonlocal last
        name = f"s{len(ctes)}"
        ctes.append(f"{name} AS (SELECT image_id, x, y, c3, {', '.join(f'{e} AS {c}' for c, e in values.items())}{more} FROM {last})")
        last = name

    each = lambda f: {c: f(c) for c in "rgb"}
    step({c: f"{decode(s)} * {gain[c] * 2**0.5!r}" for c, s in zip("rgb", RGB)})
    step(each(lambda c: c), f", {lum} AS l, 0.4 * {smooth(lum, 0.35, 1.0)} AS a")
    step(each(lambda c: f"CASE WHEN a > 0 THEN ({c} - greatest({c} - 1.0, 0) * a) * (1 - 0.35 * a) ELSE {c} * (1 - a) END"), ", l")
    step(each(lambda c: f"{c} * (1 + 0.3 * (1 - {smooth('l', 0.0, 0.5)}))"))
    step(each(lambda c: f"{c} * (1 + 0.1 * {clamp(lum, 0, 1)})"))
    step(each(lambda c: f"greatest({c} - 0.1 * 0.2 * (1 - {clamp(lum, 0, 1)}), 0)"))
    step(each(lambda c: f"greatest(({c} - 0.18) * 1.2 + 0.18, 0)"))
    step(each(lambda c: c), f", {lum} AS l, CASE WHEN greatest(r, g, b) <= 1e-6 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS k")
    step(each(lambda c: f"l + ({c} - l) * (1 + 0.3 * (1 - k))"), ", l")
    step(each(lambda c: f"greatest(l + ({c} - l) * 0.8, 0)"))
    return out(",\n".join(ctes), {n: whole(encode(c) + " * 255") for n, c in zip(RGB, "rgb")} | {"c3": "c3"}, last)


def _hist(source: str, value: str, fixed: bool) -> str:
    span = "SELECT image_id, 0.0 AS lo, 255.0 AS hi FROM px GROUP BY image_id" if fixed else f"SELECT image_id, lo, CASE WHEN hi - lo < 1e-12 THEN lo + 1 ELSE hi END AS hi FROM (SELECT image_id, min({value}) AS lo, max({value}) AS hi FROM px GROUP BY image_id)"
    return f"""{source}, sp AS ({span}),
hi AS (SELECT image_id, CAST(greatest(0, least(255, floor(({value} - lo) / (hi - lo) * 255 + 0.5))) AS INT) AS bin, lo, hi, count(*) AS n FROM px JOIN sp USING (image_id) GROUP BY ALL),
de AS (SELECT sp.image_id, sp.lo, sp.hi, CAST(b AS INT) AS bin, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM sp CROSS JOIN range(256) r(b) LEFT JOIN hi ON hi.image_id = sp.image_id AND hi.bin = b)"""


def gauss(sigma: float, k: int) -> list[float]:
    """A bell over -k..k that sums to 1."""
    bell = {i: math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)}
    return [g / math.fsum(bell.values()) for g in bell.values()]


def sector_table(radius: int, sectors: int) -> str:
    """VALUES rows (sector, dx, dy, weight) of a disc's wedges: a bell in the angle from the wedge's middle, with
    half a wedge as its width, times one in the distance, with half the radius; each place's weights add up to 1."""
    rows, wedge = [], 2 * math.pi / sectors
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if math.hypot(dx, dy) > radius:
                continue
            away = [abs(math.remainder(math.atan2(dy, dx) - s * wedge, 2 * math.pi)) if dx or dy else 0.0 for s in range(sectors)]
            bells = [math.exp(-0.5 * (a / (wedge / 2)) ** 2 - 0.5 * (dx * dx + dy * dy) / (radius / 2) ** 2) for a in away]
            rows += [f"({s}, {dx}, {dy}, CAST({b / math.fsum(bells)!r} AS DOUBLE))" for s, b in enumerate(bells)]
    return ", ".join(rows)


def _gauss_near(k: int, sigma: float, source: str, column: str) -> str:
    w = gauss(sigma, k)
    table = ", ".join(f"({i - k}, CAST({g!r} AS DOUBLE))" for i, g in enumerate(w))
    return f"""gw AS (SELECT * FROM (VALUES {table}) v(d, g)), {near('nb', source, k, (column,))},
bl AS (SELECT image_id, x, y, sum({column} * a.g * b.g) AS m FROM nb JOIN gw a ON a.d = dx JOIN gw b ON b.d = dy GROUP BY image_id, x, y)"""


def _sobel(source: str, value: str, name: str = "gr", sized: str = "px") -> str:
    return f"""lm AS (SELECT image_id, x, y, w, h, {value} AS l FROM {source}), {near('n3', 'lm', 1, ('l',))},
{name} AS (SELECT g.*, w, h FROM (SELECT image_id, x, y, sum(l * dx * (2 - abs(dy))) AS gx, sum(l * dy * (2 - abs(dx))) AS gy,
  sqrt(pow(sum(l * dx * (2 - abs(dy))), 2) + pow(sum(l * dy * (2 - abs(dx))), 2)) AS mag FROM n3 GROUP BY image_id, x, y) g JOIN {sized} USING (image_id, x, y))"""


def _thin(name: str = "th") -> str:
    go = "CASE WHEN abs(gx) > 2.414 * abs(gy) THEN {0} WHEN abs(gy) > 2.414 * abs(gx) THEN {1} WHEN (gx >= 0) = (gy >= 0) THEN {2} ELSE {3} END"
    return f"""di AS (SELECT *, {go.format(1, 0, 1, 1)} AS ux, {go.format(0, 1, 1, -1)} AS uy FROM gr),
{name} AS (SELECT d.image_id, d.x, d.y, d.w, d.h, CASE WHEN d.mag >= a.mag AND d.mag >= b.mag THEN d.mag ELSE 0 END AS c0 FROM di d
  JOIN gr a ON a.image_id = d.image_id AND a.x = greatest(0, least(d.w - 1, d.x - ux)) AND a.y = greatest(0, least(d.h - 1, d.y - uy))
  JOIN gr b ON b.image_id = d.image_id AND b.x = greatest(0, least(d.w - 1, d.x + ux)) AND b.y = greatest(0, least(d.h - 1, d.y + uy)))"""


def _flood(source: str, low: float, high: float) -> str:
    return f"""fl AS (SELECT image_id, x, y FROM {source} WHERE c0 >= {high} UNION
  SELECT s.image_id, s.x, s.y FROM fl JOIN {source} s ON s.image_id = fl.image_id AND abs(s.x - fl.x) <= 1 AND abs(s.y - fl.y) <= 1 WHERE s.c0 >= {low})
SELECT s.image_id, s.x, s.y, CAST(fl.x IS NOT NULL AS DOUBLE) AS c0 FROM {source} s LEFT JOIN fl USING (image_id, x, y)"""


def _demosaic(alpha: float, beta: float, gamma: float) -> str:
    tile = "(CASE WHEN {y} % 2 = 0 THEN CASE WHEN {x} % 2 = 0 THEN 0 ELSE 1 END ELSE CASE WHEN {x} % 2 = 0 THEN 1 ELSE 2 END END)"
    pick = lambda c: f"sum(s) FILTER ({c})"
    own, side = tile.format(x="x", y="y"), tile.format(x="(x + 1)", y="y")
    raw = {
        0: f"CASE WHEN {own} = 0 THEN c WHEN {own} = 1 THEN CASE WHEN {side} = 0 THEN lv ELSE up END ELSE co END",
        1: f"CASE WHEN {own} = 1 THEN c ELSE ed END",
        2: f"CASE WHEN {own} = 2 THEN c WHEN {own} = 1 THEN CASE WHEN {side} = 2 THEN lv ELSE up END ELSE co END",
    }
    m, mul = (0.9, 0.1, 0.0, 0.05, 0.9, 0.05, 0.0, 0.2, 0.8), (2.0, 1.0, 1.5)
    mixed = {f"c{i}": f"greatest(0, {' + '.join(f'r{j} * {m[3 * i + j]}' for j in range(3))})" for i in range(3)}
    body = f"""{VECTORS}, sn AS (SELECT image_id, x, y, w, h, {clamp('((c0 + 0.6) * 1000 - 100) / 1000', 0, 4)} AS s FROM px), {near('nb', 'sn', 2, ('s',))},
k AS (SELECT image_id, x, y, {pick('dx = 0 AND dy = 0')} AS c, {pick('abs(dx) = 1 AND dy = 0')} AS h, {pick('dx = 0 AND abs(dy) = 1')} AS v, {pick('abs(dx) = 1 AND abs(dy) = 1')} AS d,
  {pick('abs(dx) = 2 AND dy = 0')} AS h2, {pick('dx = 0 AND abs(dy) = 2')} AS v2 FROM nb GROUP BY image_id, x, y),
l AS (SELECT *, 0.5 * h + {gamma} * (5 * (2 * c - h2) - (2 * c - v2)) AS lv, 0.5 * v + {gamma} * (5 * (2 * c - v2) - (2 * c - h2)) AS up,
  0.25 * (h + v) + {alpha} * (4 * c - h2 - v2) AS ed, 0.25 * d + {beta} * (4 * c - h2 - v2) AS co FROM k),
r AS (SELECT image_id, x, y, {', '.join(f'({e}) * {mul[i]} AS r{i}' for i, e in raw.items())} FROM l),
f AS (SELECT image_id, x, y, {', '.join(f'{e} AS {c}' for c, e in mixed.items())} FROM r)"""
    return out(body, {c: half(c) for c in RGB} | {"c3": "1.0"}, "f")


#: Frames of the sensor readouts: each camera's data with its problem, and the pixels of sound frames in levels.
FRAMES = f"""em AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, label FROM embeddings),
ca AS (
  SELECT vec_id AS image_id, e, CAST(vec_id % 3 AS INT) + CASE WHEN vec_id % 50 = 17 THEN 5 - CAST(vec_id % 3 AS INT) ELSE 0 END AS lf, CAST(vec_id // 3 % 2 AS INT) AS tp,
    CAST(CASE WHEN vec_id % 50 = 19 THEN 0 ELSE 8 - vec_id % 3 - vec_id % 2 END AS INT) AS w, CAST(8 - vec_id // 3 % 2 AS INT) AS h,
    CASE WHEN vec_id % 50 = 11 THEN [0, 0, 1, 2] ELSE [[0, 1, 1, 2], [2, 1, 1, 0], [1, 0, 2, 1], [1, 2, 0, 1]][CAST(vec_id % 4 + 1 AS INT)] END AS t,
    80.0 + label + (vec_id % 5 + 1 + 2 + vec_id % 7) / 4.0 AS black, CASE WHEN vec_id % 50 = 23 THEN 10 ELSE 1100 END AS mx, 1.0 + vec_id % 2 AS g,
    vec_id % 6 <> 0 AS day, vec_id % 8 = 0 AS bare, label
  FROM em
), de AS (
  SELECT image_id, e, lf, tp, w, h, CAST(black AS DOUBLE) AS black, CAST(CASE WHEN mx <= black THEN black + 1 ELSE mx END AS DOUBLE) AS white, (1.2::DOUBLE + abs(e[2]) * 6) / g AS ar, (1.1::DOUBLE + abs(e[3]) * 6) / g AS ab,
    day, CASE WHEN day THEN 2.2::DOUBLE ELSE 1 END AS pr, CASE WHEN day THEN 1.4::DOUBLE + CAST(label AS DOUBLE) / 20 ELSE 1 END AS pb, bare,
    [[t[1 + 2 * (tp % 2) + lf % 2], t[1 + 2 * (tp % 2) + (lf + 1) % 2]], [t[1 + 2 * ((tp + 1) % 2) + lf % 2], t[1 + 2 * ((tp + 1) % 2) + (lf + 1) % 2]]] AS tile,
    CASE WHEN image_id % 50 = 7 THEN 'no mosaic' WHEN image_id % 50 = 11 THEN 'unknown colour pattern' WHEN w <= 0 THEN 'no visible frame' WHEN lf + w > 8 THEN 'lines are short' END AS problem,
    image_id % 50 = 13 AS xt
  FROM ca
), fr AS (
  SELECT image_id, CAST(i % w AS INT) AS x, CAST(i // w AS INT) AS y, w, h, black, white, ar, ab, bare, tile, xt, (e[CAST((i // w + tp) * 8 + i % w + lf + 1 AS INT)] + 0.6::DOUBLE) * 1000 AS c
  FROM (SELECT *, unnest(range(w * h)) AS i FROM de WHERE problem IS NULL AND w > 0)
), px AS (SELECT *, {clamp('(c - black) / (white - black)', 0, 4)} AS s FROM fr)"""


def _mixed_demosaic(alpha: float, beta: float, gamma: float) -> str:
    """CTEs up to ``dm`` (image_id, x, y, c0, c1, c2, c3): every sound frame by its own descriptor."""
    pick = lambda c: f"sum(s) FILTER ({c})"
    own, side = "tile[y % 2 + 1][x % 2 + 1]", "tile[y % 2 + 1][(x + 1) % 2 + 1]"
    other = lambda k: f"CASE WHEN {own} = {k} THEN c WHEN {own} = 1 THEN CASE WHEN {side} = {k} THEN lv ELSE up END ELSE co END"
    matrix = (0.9, 0.1, 0.0, 0.05, 0.9, 0.05, 0.0, 0.2, 0.8)
    mix = lambda i: f"greatest(0, CASE WHEN bare THEN r{i} ELSE r0 * {matrix[3 * i]} + r1 * {matrix[3 * i + 1]} + r2 * {matrix[3 * i + 2]} END)"
    return f"""{FRAMES}, {near('nb', 'px', 2, ('s',))},
k AS (SELECT image_id, x, y, {pick('dx = 0 AND dy = 0')} AS c, {pick('abs(dx) = 1 AND dy = 0')} AS h, {pick('dx = 0 AND abs(dy) = 1')} AS v, {pick('abs(dx) = 1 AND abs(dy) = 1')} AS d,
  {pick('abs(dx) = 2 AND dy = 0')} AS h2, {pick('dx = 0 AND abs(dy) = 2')} AS v2 FROM nb GROUP BY image_id, x, y),
l AS (SELECT image_id, x, y, c, 0.5 * h + {gamma} * (5 * (2 * c - h2) - (2 * c - v2)) AS lv, 0.5 * v + {gamma} * (5 * (2 * c - v2) - (2 * c - h2)) AS up,
  0.25 * (h + v) + {alpha} * (4 * c - h2 - v2) AS ed, 0.25 * d + {beta} * (4 * c - h2 - v2) AS co FROM k),
r AS (SELECT image_id, x, y, xt, bare, p.c AS raw, ({other(0)}) * ar AS r0, CASE WHEN {own} = 1 THEN l.c ELSE ed END AS r1, ({other(2)}) * ab AS r2 FROM l JOIN px p USING (image_id, x, y)),
f AS (SELECT image_id, x, y, xt, raw, {', '.join(f'{mix(i)} AS m{i}' for i in range(3))} FROM r),
dm AS (SELECT image_id, x, y, {', '.join(f'CASE WHEN xt THEN {half("raw")} ELSE {half(f"m{i}")} END AS c{i}' for i in range(3))}, 1.0 AS c3 FROM f)""".replace(other(0), other(0).replace("THEN c ", "THEN l.c ")).replace(other(2), other(2).replace("THEN c ", "THEN l.c "))


def _as_shot() -> str:
    """The bisections one step a row: 8 passes of 32 on the temperature and 32 on the tint."""
    def gains(k: str, t: str) -> str:
        """A struct of red and blue gains, as nested selections."""
        poly = lambda c, v: f"((({c[0]!r}::DOUBLE * {v} + {c[1]!r}::DOUBLE) * {v} + {c[2]!r}::DOUBLE) * {v} + {c[3]!r}::DOUBLE)"
        t1 = f"SELECT *, {t} AS ti, greatest(1667.0::DOUBLE, least(25000.0::DOUBLE, {k})) AS kk"
        x = f"CASE WHEN kk <= 4000 THEN {poly((-0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910), '(1 / kk)')} ELSE {poly((-3.0258469e9, 2.1070379e6, 0.2226347e3, 0.240390), '(1 / kk)')} END"
        y = f"CASE WHEN kk <= 2222 THEN {poly((-1.1063814, -1.34811020, 2.18555832, -0.20219683), 'cx')} WHEN kk <= 4000 THEN {poly((-0.9549476, -1.37418593, 2.09137015, -0.16748867), 'cx')} ELSE {poly((3.0817580, -5.87338670, 3.75112997, -0.37001483), 'cx')} END"
        row = lambda a, b, c: f"greatest({a}::DOUBLE * (cx / cy) + {b}::DOUBLE + {c}::DOUBLE * ((1 - cx - cy) / cy), 0.02::DOUBLE)"
        return f"""SELECT *, vg / vr AS gr, vg / vb AS gb FROM (SELECT *, {row(3.2404542, -1.5371385, -0.4985314)} AS vr, {row(-0.9692660, 1.8760108, 0.0415560)} AS vg, {row(0.0556434, -0.2040259, 1.0572252)} AS vb FROM (
  SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, {y} - ti * 0.05::DOUBLE)) AS cy FROM (SELECT *, {x} AS cx FROM ({t1} FROM {{0}}))))"""
    day = gains("6504.0::DOUBLE", "0.0::DOUBLE").format("(SELECT 1 AS one)")
    warm = "i % 64 < 32"
    step = gains(f"CASE WHEN {warm} THEN (lo + hi) / 2 ELSE k END", f"CASE WHEN {warm} THEN t ELSE (lo + hi) / 2 END").format("b")
    up = f"CASE WHEN {warm} THEN gr / dr / greatest(gb / db, 1e-6) < red / blue ELSE 0.5::DOUBLE * (gr / dr / red + gb / db / blue) > 1 END"
    mid = "(lo + hi) / 2"
    low, high = f"CASE WHEN {up} THEN {mid} ELSE lo END", f"CASE WHEN {up} THEN hi ELSE {mid} END"
    return f"""WITH RECURSIVE {FRAMES}, dl AS (SELECT gr AS dr, gb AS db FROM ({day})),
b AS (SELECT image_id, greatest(ar / pr, 1e-6) AS red, greatest(ab / pb, 1e-6) AS blue, dr, db, 0 AS i, 2000.0::DOUBLE AS lo, 25000.0::DOUBLE AS hi, 6504.0::DOUBLE AS k, 0.0::DOUBLE AS t FROM de, dl WHERE day
  UNION ALL
  SELECT image_id, red, blue, dr, db, i + 1, CASE WHEN i % 64 = 31 THEN -1.0::DOUBLE WHEN i % 64 = 63 THEN 2000.0::DOUBLE ELSE nlo END, CASE WHEN i % 64 = 31 THEN 1.0::DOUBLE WHEN i % 64 = 63 THEN 25000.0::DOUBLE ELSE nhi END,
    CASE WHEN i % 64 = 31 THEN (nlo + nhi) / 2 ELSE k END, CASE WHEN i % 64 = 63 THEN (nlo + nhi) / 2 ELSE t END
  FROM (SELECT *, {low} AS nlo, {high} AS nhi FROM ({step})) WHERE i < 512)
SELECT image_id, coalesce(round(k, 1), 0) AS kelvin, coalesce(round(t, 5), 0) AS tint FROM (SELECT image_id FROM de) LEFT JOIN (SELECT * FROM b WHERE i = 512) USING (image_id)"""


PLACES = "pt AS (SELECT vec_id * 2 + k AS point_id, vec_id AS image_id, CAST(label + k * 3 - 2 AS INT) AS cx, CAST(vec_id % 14 - 3 AS INT) AS cy FROM embeddings, range(2) r(k))"


def _window(radius: int) -> str:
    """CTEs up to ``wi``: a row a place of each point's window, the edge's value for those beyond it."""
    return f"""{VECTORS}, {PLACES},
wi AS (SELECT point_id, image_id, c0 FROM (SELECT point_id, pt.image_id, greatest(0, least(z.w - 1, cx + dx)) AS x, greatest(0, least(z.h - 1, cy + dy)) AS y
  FROM pt JOIN (SELECT DISTINCT image_id, w, h FROM px) z USING (image_id), range(-{radius}, {radius} + 1) a(dx), range(-{radius}, {radius} + 1) b(dy)) JOIN px USING (image_id, x, y))"""


def oracle_sql() -> dict[str, str]:
    d2 = "(dx * dx + dy * dy)"
    q: dict[str, str] = {}
    gray = whole("(c0 * 0.299 + c1 * 0.587 + c2 * 0.114) / 1.0")
    q["grayscale"] = out(EVENTS, {c: gray for c in RGB} | {"c3": "c3"}, "px")
    q["brightness"] = out(EVENTS, {c: whole(f"{c} * 1.2 + 0.1 * 255") for c in RGB} | {"c3": "c3"}, "px")
    q["basic_adjust"] = _basic()
    q["threshold"] = mask(EVENTS, "100", "px")
    own = "OVER (PARTITION BY image_id)"
    cum = "OVER (PARTITION BY image_id ORDER BY bin)"
    value = lambda b: f"lo + ({b}) / 255.0 * (hi - lo)"
    q["threshold_otsu"] = mask(
        f"""{_hist(EVENTS, LUMA, True)}, a AS (SELECT *, sum(n) {cum} AS wb, sum(n * bin) {cum} AS sb, sum(n) {own} AS al, sum(n * bin) {own} AS tot FROM de),
b AS (SELECT *, CASE WHEN wb > 0 AND wb < al THEN wb * (al - wb) * pow(sb / nullif(wb, 0) - (tot - sb) / nullif(al - wb, 0), 2) END AS v FROM a), m AS (SELECT *, max(v) {own} AS best FROM b),
t AS (SELECT image_id, {value('coalesce((min(bin) FILTER (v > best - greatest(1e-9, best * 1e-12)) + max(bin) FILTER (v > best - greatest(1e-9, best * 1e-12))) / 2.0, 128.0)')} AS t FROM m GROUP BY image_id, lo, hi)""",
        "t", "px JOIN t USING (image_id)",
    )
    q["threshold_triangle"] = mask(
        f"""{_hist(EVENTS, LUMA, True)}, a AS (SELECT *, first_value(bin) OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS peak, min(bin) FILTER (n > 0) {own} AS first, max(bin) FILTER (n > 0) {own} AS last FROM de),
b AS (SELECT *, CASE WHEN peak - first < last - peak THEN peak ELSE first END AS p, CASE WHEN peak - first < last - peak THEN last ELSE peak END AS z FROM a),
c AS (SELECT *, max(n) FILTER (bin = p) {own} AS y0, max(n) FILTER (bin = z) {own} AS y1 FROM b),
d AS (SELECT *, abs((y1 - y0) * (bin - p) - (z - p) * (n - y0)) / sqrt(pow(z - p, 2) + pow(y1 - y0, 2)) AS d FROM c WHERE bin BETWEEN p AND z AND z > p),
t AS (SELECT image_id, {value('arg_max(bin, (d, -bin))')} AS t FROM d GROUP BY image_id, lo, hi)""",
        "t", "px JOIN t USING (image_id)",
    )
    q["threshold_isodata"] = f"""WITH RECURSIVE {_hist(VECTORS, 'c0', False)},
cu AS (SELECT image_id, bin, lo, hi, sum(n) {cum} AS nl, sum(n * bin) {cum} AS sl, sum(n) {own} AS al, sum(n * bin) {own} AS tot FROM de),
it AS (SELECT DISTINCT image_id, 0 AS i, 128 AS t FROM cu UNION ALL
  SELECT it.image_id, i + 1, CASE WHEN nl = 0 OR al - nl = 0 THEN t ELSE CAST(floor((sl / nullif(nl, 0) + (tot - sl) / nullif(al - nl, 0)) * 0.5 + 0.5) AS INT) END
  FROM it JOIN cu ON cu.image_id = it.image_id AND cu.bin = it.t WHERE i < 128),
f AS (SELECT it.image_id, lo + t / 255.0 * (hi - lo) AS t FROM it JOIN sp USING (image_id) WHERE i = 128)
SELECT image_id, x, y, CAST(NOT c0 > t AS DOUBLE) AS c0 FROM px JOIN f USING (image_id)"""
    both = "px JOIN st USING (image_id, x, y)"
    q["threshold_niblack"] = mask(f"{EVENTS}, {inside('st', 'px', 3, LUMA)}", "mean - 0.2 * sd", both)
    q["threshold_sauvola"] = mask(f"{EVENTS}, {inside('st', 'px', 3, LUMA)}", "mean * (1 + 0.2 * (sd / 128 - 1))", both)
    q["threshold_bernsen"] = mask(f"{EVENTS}, {inside('st', 'px', 2, LUMA)}", "CASE WHEN hi - lo < 15 THEN CASE WHEN (lo + hi) / 2 >= 128 THEN -1e30 ELSE 1e30 END ELSE (lo + hi) / 2 END", both)
    q["threshold_adaptive_mean"] = mask(f"{EVENTS}, {inside('st', 'px', 4, LUMA)}", "mean - 5", both)
    q["threshold_adaptive_gaussian"] = mask(f"{VECTORS}, {_gauss_near(3, 2.0, 'px', 'c0')}", "m", "px JOIN bl USING (image_id, x, y)", "c0")
    grouped = lambda es: ", ".join(f"{e} AS {c}" for c, e in es.items())
    q["box_blur"] = out(f"{EVENTS}, {near('nb', 'px', 3, RGBA)}, s AS (SELECT image_id, x, y, {grouped({c: f'sum({c})' for c in RGBA})} FROM nb GROUP BY image_id, x, y)", {c: whole(f"{c} / 49.0") for c in RGBA}, "s")
    q["gaussian_blur"] = out(f"{VECTORS}, {_gauss_near(3, 1.0, 'px', 'c0')}", {"c0": "m"}, "bl")
    alpha = "JOIN (SELECT image_id, x, y, c3 AS a3 FROM px) USING (image_id, x, y)"
    q["median_blur"] = out(f"{EVENTS}, {near('nb', 'px', 2, RGB)}, s AS (SELECT image_id, x, y, {grouped({c: f'median({c})' for c in RGB})} FROM nb GROUP BY image_id, x, y)", {c: whole(c) for c in RGB} | {"c3": "a3"}, f"s {alpha}")
    wt = f"exp(-{d2} / 2.0) * exp(-(pow(c0 - m0, 2) + pow(c1 - m1, 2) + pow(c2 - m2, 2)) / (2 * pow(0.2010 * 255, 2)))"
    q["bilateral"] = out(
        f"{EVENTS}, {near('nb', 'px', 2, RGB, ', p.c0 AS m0, p.c1 AS m1, p.c2 AS m2')}, k AS (SELECT *, {wt} AS g FROM nb), s AS (SELECT image_id, x, y, {grouped({c: f'sum(g * {c}) / greatest(sum(g), 1e-8)' for c in RGB})} FROM k GROUP BY image_id, x, y)",
        {c: whole(c) for c in RGB} | {"c3": "a3"}, f"s {alpha}",
    )
    q["guided_filter"] = out(
        f"""{VECTORS}, {near('nb', 'px', 2, ('c0',))}, m AS (SELECT image_id, x, y, avg(c0) AS m, greatest(0, avg(c0 * c0) - avg(c0) * avg(c0)) AS v FROM nb GROUP BY image_id, x, y),
ab AS (SELECT image_id, x, y, w, h, v / (v + 0.01) AS a, (1 - v / (v + 0.01)) * m AS b FROM m JOIN px USING (image_id, x, y)), {near('n2', 'ab', 2, ('a', 'b'))},
s AS (SELECT image_id, x, y, avg(a) AS a, avg(b) AS b FROM n2 GROUP BY image_id, x, y)""",
        {"c0": "a * c0 + b"}, "s JOIN px USING (image_id, x, y)",
    )
    steps, last = [VECTORS], "px"
    for i in range(3):
        steps.append(f"""{near(f'f{i}', last, 1, ('c0',), ', p.c0 AS m')}, g{i} AS (SELECT image_id, x, y, any_value(m) + 0.2 * sum((c0 - m) * exp(-pow(c0 - m, 2) / 0.0025)) FILTER (abs(dx) + abs(dy) = 1) AS c0 FROM f{i} GROUP BY image_id, x, y),
e{i} AS (SELECT image_id, x, y, w, h, g{i}.c0 FROM g{i} JOIN px USING (image_id, x, y))""")
        last = f"e{i}"
    q["anisotropic_diffusion"] = out(",\n".join(steps), {"c0": "c0"}, last)
    quad = "(SELECT * FROM (VALUES (0, -2, 0, -2, 0), (1, 0, 2, -2, 0), (2, -2, 0, 0, 2), (3, 0, 2, 0, 2)) v(i, xa, xb, ya, yb))"
    q["kuwahara"] = out(
        f"""{EVENTS}, {near('nb', 'px', 2, RGB)}, s AS (SELECT image_id, x, y, i, {grouped({c: f'avg({c})' for c in RGB})}, round(greatest(0, avg({LUMA} * {LUMA}) - avg({LUMA}) * avg({LUMA})), 6) AS v
  FROM nb JOIN {quad} ON dx BETWEEN xa AND xb AND dy BETWEEN ya AND yb GROUP BY image_id, x, y, i), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY v, i) = 1)""",
        {c: whole(c) for c in RGB} | {"c3": "a3"}, f"b {alpha}",
    )
    table = sector_table(2, 8)
    q["kuwahara_generalized"] = out(
        f"""{VECTORS}, sw AS (SELECT * FROM (VALUES {table}) v(s, dx, dy, g)), {near('nb', 'px', 2, ('c0',))},
m AS (SELECT image_id, x, y, s, sum(c0 * g) / sum(g) AS m, sum(c0 * c0 * g) / sum(g) AS qq FROM nb JOIN sw USING (dx, dy) GROUP BY image_id, x, y, s),
k AS (SELECT *, 1 / (1 + pow(greatest(0, qq - m * m), 4.0)) AS wt FROM m)""",
        {"c0": "sum(m * wt) / greatest(sum(wt), 1e-8)"}, "k GROUP BY image_id, x, y",
    )
    lum = lambda t: f"(0.299 * {t}.c0 + 0.587 * {t}.c1 + 0.114 * {t}.c2)"
    q["symmetric_nearest"] = out(
        f"""{EVENTS}, {near('nb', 'px', 2, RGB)}, k AS (SELECT a.image_id, a.x, a.y, {grouped({c: f'CASE WHEN abs({lum("a")} - {lum("p")}) <= abs({lum("b")} - {lum("p")}) THEN a.{c} ELSE b.{c} END' for c in RGB})}
  FROM nb a JOIN nb b ON b.image_id = a.image_id AND b.x = a.x AND b.y = a.y AND b.dx = -a.dx AND b.dy = -a.dy JOIN px p ON p.image_id = a.image_id AND p.x = a.x AND p.y = a.y WHERE a.dy < 0 OR a.dy = 0 AND a.dx < 0),
t AS (SELECT image_id, x, y, {', '.join(RGB)} FROM k UNION ALL SELECT image_id, x, y, {', '.join(RGB)} FROM px), s AS (SELECT image_id, x, y, {grouped({c: f'sum({c}) / 13.0' for c in RGB})} FROM t GROUP BY image_id, x, y)""",
        {c: whole(c) for c in RGB} | {"c3": "a3"}, f"s {alpha}",
    )
    h2 = (0.301) ** 2
    q["nonlocal_means"] = out(
        f"""{VECTORS}, {near('sr', 'px', 2, ('c0',), ', p.c0 AS m, p.w, p.h')}, pt AS (SELECT px_, py_ FROM range(-1, 2) a(px_), range(-1, 2) b(py_)),
pa AS MATERIALIZED (SELECT s.*, greatest(0, least(w - 1, x + px_)) AS ax, greatest(0, least(h - 1, y + py_)) AS ay, greatest(0, least(w - 1, x + dx + px_)) AS bx, greatest(0, least(h - 1, y + dy + py_)) AS by_ FROM sr s CROSS JOIN pt),
d AS (SELECT s.image_id, s.x, s.y, dx, dy, s.c0, s.m, avg(pow(a.c0 - b.c0, 2)) AS d FROM pa s
  JOIN px a ON a.image_id = s.image_id AND a.x = ax AND a.y = ay JOIN px b ON b.image_id = s.image_id AND b.x = bx AND b.y = by_ GROUP BY ALL),
k AS (SELECT *, CASE WHEN pow(c0 - m, 2) <= 9 * {h2!r} THEN exp(-d / {h2!r}) ELSE 0 END AS g FROM d)""",
        {"c0": "sum(g * c0) / greatest(sum(g), 1e-8)"}, "k GROUP BY image_id, x, y",
    )
    q["sobel"] = f"WITH {EVENTS}, {_sobel('px', LUMA + ' / 255.0')} SELECT image_id, x, y, round(gx, 6) AS gx, round(gy, 6) AS gy, round(mag, 6) AS mag FROM gr"
    q["non_max_suppression"] = out(f"{VECTORS}, {_sobel('px', 'c0')}, {_thin()}", {"c0": "c0"}, "th")
    q["hysteresis"] = f"WITH RECURSIVE {VECTORS}, {_flood('px', 0.1, 0.2)}"
    sized = "bs AS (SELECT image_id, x, y, w, h, m FROM bl JOIN px USING (image_id, x, y))"
    q["canny"] = f"WITH RECURSIVE {VECTORS}, {_gauss_near(3, 1.0, 'px', 'c0')}, {sized}, {_sobel('bs', 'm')}, {_thin()}, {_flood('th', 0.2, 0.6)}"
    tinted = clamp("((c0 + 0.6) * 1000 - 100) / 1000", 0, 4)
    at = "(y % 2 + x % 2)"
    q["demosaic_passthrough"] = out(VECTORS, {f"c{i}": f"CASE WHEN {at} = {i} THEN {half(tinted)} ELSE 0.0 END" for i in range(3)} | {"c3": "1.0"}, "px")
    q["demosaic_bilinear"], q["demosaic_malvar"] = _demosaic(0, 0, 0), _demosaic(0.125, 0.1875, 0.0625)
    q["histogram"] = f"WITH {_hist(VECTORS, 'c0', False)} SELECT image_id, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM hi"
    q["histogram_finish"] = f"""WITH {_hist(EVENTS, LUMA, True)}, v AS (SELECT image_id, bin, n, {value('bin')} AS v, sum(n) {cum} AS up, sum(n) {own} AS al FROM hi)
SELECT image_id, CAST(sum(n) AS BIGINT) AS count, round(sum(n * v) / sum(n), 6) AS mean, round(min(v) FILTER (up >= 0.5 * al), 6) AS median, round(min(v) FILTER (up >= 0.9 * al), 6) AS percentile,
  round(min(v), 6) AS least, round(max(v), 6) AS most, arg_max(bin, (n, -bin)) AS peak, round(greatest(0, sum(n * v * v) / sum(n) - pow(sum(n * v) / sum(n), 2)), 6) AS variance,
  round(sqrt(greatest(0, sum(n * v * v) / sum(n) - pow(sum(n * v) / sum(n), 2))), 6) AS sd FROM v GROUP BY image_id"""
    q["image_stats"] = f"""WITH {_hist(VECTORS, 'c0', False)}, v AS (SELECT image_id, bin, n, {value('bin')} AS v, sum(n) {cum} AS up, sum(n) {own} AS al FROM hi)
SELECT image_id, CAST(sum(n) AS BIGINT) AS count, round(sum(n * v) / sum(n), 6) AS mean, round(min(v) FILTER (up >= 0.5 * al), 6) AS median, round(sqrt(greatest(0, sum(n * v * v) / sum(n) - pow(sum(n * v) / sum(n), 2))), 6) AS sd,
  round(coalesce(sum(n) FILTER (bin = 0), 0) / sum(n), 6) AS clip_low, round(coalesce(sum(n) FILTER (bin = 255), 0) / sum(n), 6) AS clip_high, max(n) FILTER (bin BETWEEN 1 AND 254) AS peak_count,
  round(max(hi), 6) AS max_value, max(hi) > 1.0001 AS headroom FROM v JOIN sp USING (image_id) GROUP BY image_id"""
    b = {c: whole(f"{c} + 0.1 * 255") for c in RGB}
    d = [f"abs({c} - {b[c]})" for c in RGB]
    q["compare"] = f"""WITH {EVENTS}, d AS (SELECT image_id, {', '.join(f'{e} AS d{i}' for i, e in enumerate(d))} FROM px)
SELECT image_id, round(max(greatest(d0, d1, d2)), 6) AS max_diff, round(sum(d0 + d1 + d2) / (count(*) * 3), 6) AS mean_diff, round(sqrt(sum(d0 * d0 + d1 * d1 + d2 * d2) / (count(*) * 3)), 6) AS rmse,
  count(*) FILTER (greatest(d0, d1, d2) > 20) AS diff_pixels, count(*) AS pixels FROM d GROUP BY image_id"""
    worst = "least(255.0, 16.0 * greatest(" + ", ".join(f"abs({c} - {whole(f'{c} + 0.02 * 255')})" for c in RGB) + "))"
    q["diff_image"] = out(EVENTS, {"c0": f"floor({worst})", "c1": f"floor({worst} * 0.25)", "c2": f"floor({worst} * 0.25)", "c3": "255.0"}, "px")
    shade = "floor(round((c0 - lo) / CASE WHEN hi - lo <= 1e-8 THEN 1 ELSE hi - lo END * 255, 9))"
    q["display_normalise"] = out(f"{VECTORS}, m AS (SELECT image_id, min(c0) AS lo, max(c0) AS hi FROM px GROUP BY image_id)", {c: shade for c in RGB} | {"c3": "255.0"}, "px JOIN m USING (image_id)")
    q["thumbnail"] = f"""WITH {EVENTS}, s AS (SELECT *, CAST(greatest(1, ceil(greatest(w, h) / 32.0)) AS INT) AS st FROM px)
SELECT image_id, x // st AS x, y // st AS y, {', '.join(f'CAST(sum(CAST({c} AS BIGINT)) // count(*) AS BIGINT) AS {c}' for c in RGBA)} FROM s WHERE x // st < greatest(1, w // st) AND y // st < greatest(1, h // st) GROUP BY image_id, x // st, y // st"""
    grey = "CAST(floor(greatest(0.0, least(1.0, c0)) * 255) AS BIGINT)"
    q["thumbnail_float"] = f"""WITH {VECTORS}, s AS (SELECT *, {grey} AS v, CAST(greatest(1, ceil(greatest(w, h) / 4.0)) AS INT) AS st FROM px)
SELECT image_id, x // st AS x, y // st AS y, {', '.join(f'CAST(sum(v) // count(*) AS BIGINT) AS c{i}' for i in range(3))}, CAST(255 AS BIGINT) AS c3 FROM s WHERE x // st < greatest(1, w // st) AND y // st < greatest(1, h // st) GROUP BY image_id, x // st, y // st"""
    q["region"] = out(EVENTS, {c: c for c in RGBA}, "px WHERE x BETWEEN 0 AND 14 AND y BETWEEN 0 AND 14")
    q["png_round_trip"] = out(f"{VECTORS}, k AS (SELECT *, CAST(c0 > 0 AS INT) AS v FROM px), m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM k GROUP BY image_id)", {c: "CAST((v - lo) * 255 AS DOUBLE)" for c in RGB} | {"c3": "255.0"}, "k JOIN m USING (image_id)")
    q["integral_image"] = f"""WITH {EVENTS}, li AS (SELECT image_id, x, y, sum(c0) OVER a AS t, sum(c0 * c0) OVER a AS s FROM px WINDOW a AS (PARTITION BY image_id, y ORDER BY x))
SELECT image_id, x, y, sum(t) OVER b AS total, sum(s) OVER b AS squares FROM li WINDOW b AS (PARTITION BY image_id, x ORDER BY y)"""
    branch = lambda name, same, users, test, source: f"SELECT '{name}' AS chain, '{same}' AS same_as, {users} AS users, count(*) AS pixels, CAST(count(*) FILTER ({test}) AS BIGINT) AS bright FROM {source}"
    blurred = f"{EVENTS}, {near('nb', 'px', 2, RGB)}, b5 AS (SELECT image_id, x, y, {', '.join(f'floor(round(sum({c}) / 25.0, 9)) AS {c}' for c in RGB)} FROM nb GROUP BY image_id, x, y)"
    bright, dark = f"{LUMA} > 100", f"NOT {LUMA} > 120"
    q["shared_branches"] = f"WITH {blurred} " + " UNION ALL ".join([branch("a", "a", 4, bright, "b5"), branch("b", "b", 4, dark, "b5"), branch("c", "b", 4, dark, "b5"), branch("d", "d", 4, bright, "b5"), branch("e", "e", 1, dark, "px")])
    stretched = VECTORS.replace("CAST(embedding[i + 1] AS DOUBLE) AS c0", "CAST(embedding[i + 1] AS DOUBLE) * 4 AS c0")
    q["image_info"] = f"""WITH {_hist(stretched, 'c0', False)}, v AS (SELECT image_id, bin, n, hi, {value('bin')} AS v, sum(n) {cum} AS up, sum(n) {own} AS al FROM hi),
g AS (SELECT image_id, sum(n * v) / sum(n) AS mean, min(v) FILTER (up >= 0.5 * al) AS median, sqrt(greatest(0, sum(n * v * v) / sum(n) - pow(sum(n * v) / sum(n), 2))) AS sd,
  coalesce(sum(n) FILTER (bin = 0), 0) / sum(n) AS lo, coalesce(sum(n) FILTER (bin = 255), 0) / sum(n) AS up, max(hi) AS most FROM v GROUP BY image_id),
z AS (SELECT image_id, max(w) AS w, max(h) AS h FROM px GROUP BY image_id)
SELECT image_id, printf('%d x %d  (%.1f MP)', w, h, w * h / 1e6) AS size, printf('R32F   %.1f MB', w * h * 4 / 1e6) AS storage, printf('mean %.3f   median %.3f   stddev %.3f', mean, median, sd) AS stats,
  CASE WHEN lo > 0.01 OR up > 0.01 THEN printf('clipped: %.1f%% black, %.1f%% white', lo * 100, up * 100) END AS clipped, CASE WHEN most > 1.0001 THEN printf('headroom to %.2f (%.1f stops above white)', most, log2(most)) END AS headroom FROM g JOIN z USING (image_id)"""
    files = f"{VECTORS}, bt AS (SELECT image_id, image_id % 8 AS k, x, y, w, h, CAST(floor({clamp('floor((c0 + 0.6) * 200)', 0, 255)}) AS INT) AS v FROM px)"
    seen = {"c0": "CASE k WHEN 2 THEN v // 16 ELSE v END", "c1": "CASE k WHEN 1 THEN v WHEN 2 THEN v // 16 * 3 ELSE 255 - v END", "c2": "CASE k WHEN 1 THEN v WHEN 2 THEN v // 16 * 5 ELSE v // 2 END", "c3": "CASE k WHEN 1 THEN 255 WHEN 4 THEN 255 WHEN 2 THEN v // 16 * 16 ELSE v | 1 END"}
    q["pictures_decoded"] = out(files, {c: f"CAST({e} AS DOUBLE)" for c, e in seen.items()}, "bt WHERE k NOT IN (5, 6)")
    q["picture_status"] = f"""WITH {files} SELECT image_id, CASE k WHEN 4 THEN 'bmp' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'png' END AS kind, CASE WHEN k IN (5, 6) THEN 0 ELSE w END AS w, CASE WHEN k IN (5, 6) THEN 0 ELSE h END AS h,
  CASE k WHEN 5 THEN 'damaged' WHEN 6 THEN 'unsupported' ELSE 'ok' END AS status, CASE k WHEN 5 THEN 'picture ends early' WHEN 6 THEN 'unknown format' END AS problem FROM bt GROUP BY ALL"""
    q["latest_control"] = "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id"
    seen = ", ".join(f"round({e}, 6) AS {n}" for n, e in {"black": "black", "white": "white", "cam_mul_1": "ar", "cam_mul_3": "ab", "pre_mul_1": "pr", "pre_mul_3": "pb", "rgb_cam_1": "CASE WHEN bare THEN 1 ELSE 0.9::DOUBLE END", "rgb_cam_2": "CASE WHEN bare THEN 0 ELSE 0.1::DOUBLE END", "rgb_cam_9": "CASE WHEN bare THEN 1 ELSE 0.8::DOUBLE END"}.items())
    named = "CASE WHEN image_id % 50 IN (7, 11) THEN 'None' WHEN xt THEN 'XTrans' WHEN tile = [[0, 1], [1, 2]] THEN 'RGGB' WHEN tile = [[2, 1], [1, 0]] THEN 'BGGR' WHEN tile = [[1, 0], [2, 1]] THEN 'GRBG' ELSE 'GBRG' END"
    q["sensor_descriptors"] = f"WITH {FRAMES} SELECT image_id, w, h, {named} AS cfa, {seen}, day AS has_daylight_wb, problem FROM de"
    q["plans_compared"] = f"""WITH {VECTORS} SELECT operator, count(DISTINCT image_id) AS images, CAST(count(*) AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS diff_pixels, true AS close
FROM px, (VALUES ('box_blur'), ('gaussian_blur'), ('kuwahara')) v(operator) GROUP BY operator"""
    q["catalog_upsert"] = """WITH l AS (SELECT 'slot-' || (vec_id * 7 % 97) AS name, vec_id, embedding, max((label % 2, vec_id)) OVER (PARTITION BY vec_id * 7 % 97) AS last, count(*) OVER (PARTITION BY vec_id * 7 % 97) AS loads FROM embeddings)
SELECT name, loads - 1 AS version, CAST(len(embedding) AS BIGINT) AS pixels, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM l WHERE last[2] = vec_id"""
    numbered = "e AS (SELECT user_id, ts, event_id * 7919 % 100003 AS seq, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
    q["debounced_controls"] = f"""WITH {numbered}, g AS (SELECT *, ts - coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts - INTERVAL 1 DAY) > INTERVAL 2 HOUR AS fresh FROM e),
b AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS fired, max((seq, value))[1] AS seq, round(max((seq, value))[2], 6) AS value, count(*) AS changes FROM b GROUP BY user_id, burst"""
    q["fresh_results"] = f"""WITH {numbered} SELECT user_id, ts, seq, round(value, 6) AS value FROM (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM e) WHERE shown IS NULL OR seq > shown"""
    block = ", ".join(f"({c} + bx * {k} + yy) % 256 AS {c}" for c, k in (("c0", 1), ("c1", 2), ("c2", 3)))
    large = f"""{EVENTS}, wd AS (SELECT image_id, x * 8 + bx AS x, y * 8 + yy AS y, w * 8 AS w, h * 8 AS h, {block} FROM px, range(8) a(bx), range(8) b(yy)),
st AS (SELECT min(s) AS s FROM (SELECT DISTINCT w, h FROM wd) d, range(1, 5000) r(s) WHERE (w // (s + 1)) * (h // (s + 1)) <= 262144),
sm AS (SELECT wd.* FROM wd, st WHERE x % s = 0 AND y % s = 0 AND x // s < greatest(1, w // s) AND y // s < greatest(1, h // s)),
cd AS (SELECT image_id, unnest(['red', 'green', 'blue', 'luma']) AS channel, unnest([c0, c1, c2, {LUMA}]) AS v FROM sm),
hs AS (SELECT image_id, channel, CAST(floor(v + 0.5) AS INT) AS bin, count(*) AS n FROM cd GROUP BY ALL)"""
    q["image_histograms"] = f"WITH {large} SELECT image_id, channel, bin, n FROM hs"
    q["image_stats_large"] = f"""WITH {large}, u AS (SELECT *, sum(n) OVER (PARTITION BY image_id, channel ORDER BY bin) AS up, sum(n) OVER (PARTITION BY image_id, channel) AS al FROM hs)
SELECT image_id, CAST(sum(n) FILTER (channel = 'luma') AS BIGINT) AS count, round(sum(n * bin) FILTER (channel = 'luma') / max(al), 6) AS mean, CAST(min(bin) FILTER (channel = 'luma' AND up >= 0.5 * al) AS DOUBLE) AS median,
  round(sqrt(sum(n * bin * bin) FILTER (channel = 'luma') / max(al) - pow(sum(n * bin) FILTER (channel = 'luma') / max(al), 2)), 6) AS sd, round(coalesce(sum(n) FILTER (channel = 'luma' AND bin = 0), 0) / max(al), 6) AS clip_low,
  round(coalesce(sum(n) FILTER (channel = 'luma' AND bin = 255), 0) / max(al), 6) AS clip_high, max(n) FILTER (channel <> 'luma' AND bin BETWEEN 1 AND 254) AS peak_count, 255.0 AS max_value, false AS headroom FROM u GROUP BY image_id"""
    q["thumbnail_slim"] = f"""WITH {EVENTS}, s AS (SELECT *, CAST(greatest(1, ceil(greatest(2, h) / 32.0)) AS INT) AS st FROM px WHERE x < 2)
SELECT image_id, x // st AS x, y // st AS y, {', '.join(f'CAST(sum(CAST({c} AS BIGINT)) // count(*) AS BIGINT) AS {c}' for c in RGBA)} FROM s WHERE x // st < greatest(1, 2 // st) AND y // st < greatest(1, h // st) GROUP BY image_id, x // st, y // st"""
    q["compare_sizes"] = f"""WITH {VECTORS} SELECT image_id, round(CASE WHEN image_id % 2 = 0 THEN max(abs(c0) / 2) ELSE 0 END, 6) AS max_diff, round(CASE WHEN image_id % 2 = 0 THEN avg(abs(c0) / 2) ELSE 0 END, 6) AS mean_diff,
  round(CASE WHEN image_id % 2 = 0 THEN sqrt(avg(c0 * c0 / 4)) ELSE 0 END, 6) AS rmse, CASE WHEN image_id % 2 = 0 THEN count(*) FILTER (abs(c0) / 2 > 0.01) ELSE 0 END AS diff_pixels, CASE WHEN image_id % 2 = 0 THEN count(*) ELSE 0 END AS pixels FROM px GROUP BY image_id"""
    q["kuwahara_float"] = out(
        f"""{VECTORS}, {near('nb', 'px', 2, ('c0',))}, s AS (SELECT image_id, x, y, i, avg(c0) AS c0, greatest(0, avg(c0 * c0) - avg(c0) * avg(c0)) AS v
  FROM nb JOIN {quad} ON dx BETWEEN xa AND xb AND dy BETWEEN ya AND yb GROUP BY image_id, x, y, i), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY v, i) = 1)""",
        {"c0": "c0"}, "b",
    )
    q["sensor_demosaic"] = out(_mixed_demosaic(0.125, 0.1875, 0.0625), {c: c for c in RGBA}, "dm")
    q["as_shot_balance"] = _as_shot()
    shade = f"floor({clamp('(e[i + 1] + 0.6::DOUBLE) / 1.2::DOUBLE', 0, 1)} * 255)"
    q["resolved_sources"] = f"""WITH {_mixed_demosaic(0, 0, 0)}
SELECT image_id, x, y, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, 'frame-' || image_id AS name, 'RGBA16F' AS fmt, true AS linear FROM dm
UNION ALL SELECT -vec_id - 1, CAST(i % 8 AS INT), CAST(i // 8 AS INT), {shade}, {shade}, {shade}, 255.0, 'picture-' || (-vec_id - 1), 'RGBA8', false FROM (SELECT vec_id, e, unnest(range(len(e))) AS i FROM em WHERE vec_id % 4 = 0)"""
    q["window_stats"] = f"""WITH {_window(3)} SELECT point_id, image_id, count(*) AS n, round(avg(c0), 6) AS mean, round(sqrt(greatest(0, avg(c0 * c0) - avg(c0) * avg(c0))), 6) AS sd, round(min(c0), 6) AS least, round(max(c0), 6) AS most
FROM wi GROUP BY point_id, image_id"""
    q["window_histogram"] = f"""WITH {_window(2)}, sp AS (SELECT image_id, min(c0) AS lo, CASE WHEN max(c0) - min(c0) < 1e-12 THEN min(c0) + 1 ELSE max(c0) END AS hi FROM px GROUP BY image_id)
SELECT point_id, image_id, CAST(greatest(0, least(255, floor((c0 - lo) / (hi - lo) * 255 + 0.5))) AS INT) AS bin, count(*) AS n FROM wi JOIN sp USING (image_id) GROUP BY ALL"""
    return q
