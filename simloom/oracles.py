"""DuckDB SQL for the queries. Builders return the text of common table expressions."""

from __future__ import annotations

import numpy as np

from simloom.queries import COSINE, HASHES, KS, LENGTH, PASSES, PLANE_PASSES, PLANE_SEED, SINK_VALUES, TECHNIQUE_VALUES, THRESHOLD
from simloom.sources.results import COMMON, PARAMETERS, TECHNIQUE_COLUMNS


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _nodes(*attributes: str, padding: bool = False) -> str:
    """grams(id, g) and nodes(nid, key, n, node_count)."""
    side = "_" if padding else ""
    texts = " UNION ALL ".join(f"SELECT p_partkey AS id, '{side}' || coalesce({a}, '') || '{side}' AS s FROM part" for a in attributes or ("p_name",))
    return f"""recs AS ({texts}),
grams AS (SELECT DISTINCT id, substr(s, i, 2) AS g FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM recs)),
sets AS (SELECT p_partkey AS id, coalesce(key, '') AS key, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT id, array_to_string(list_sort(list(g)), '|') AS key, count(*) AS n FROM grams GROUP BY id) k ON k.id = p_partkey),
nodes AS (SELECT min(id) AS nid, key, min(n)::DOUBLE AS n, count(*) AS node_count FROM sets GROUP BY key)"""


def _edges(*attributes: str) -> str:
    """and edges(src, dst, weight) at the threshold."""
    return f"""{_nodes(*attributes)},
ng AS (SELECT nid, n, g FROM nodes JOIN grams ON grams.id = nid),
edges AS (SELECT a.nid AS src, b.nid AS dst, 2.0 * count(*) / (min(a.n) + min(b.n)) AS weight FROM ng a JOIN ng b ON a.g = b.g AND a.nid < b.nid GROUP BY a.nid, b.nid HAVING 2.0 * count(*) / (min(a.n) + min(b.n)) >= {THRESHOLD}),
sym AS (SELECT src AS v, dst AS n, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS (SELECT v, count(*) AS deg FROM sym GROUP BY v)"""


_M = 4294967296


def _hashes(seeds: int) -> str:
    """h(g, seed, hash) for the distinct two-character ASCII grams."""
    return f"""hk AS (SELECT g, seed, ((unicode(substr(g, 1, 1)) + 256 * unicode(substr(g, 2, 1)))::HUGEINT * 3432918353) % {_M} AS k FROM (SELECT DISTINCT g FROM grams), (SELECT unnest(range({seeds})) AS seed)),
hl AS (SELECT g, seed, (((k * 32768) % {_M} + k // 131072) * 461845907) % {_M} AS k FROM hk),
h0 AS (SELECT g, seed, xor(xor(seed::BIGINT, k::BIGINT), 2::BIGINT) AS h FROM hl),
h1 AS (SELECT g, seed, ((xor(h, h >> 16)::HUGEINT * 2246822507) % {_M})::BIGINT AS h FROM h0),
h2 AS (SELECT g, seed, ((xor(h, h >> 13)::HUGEINT * 3266489909) % {_M})::BIGINT AS h FROM h1),
h AS (SELECT g, seed, xor(h, h >> 16) AS hash FROM h2)"""


def _filters() -> str:
    """bits(id, pos), enc(nid, bits, ps, node_count), enc edges' estimate."""
    return f"""{_nodes()}, {_hashes(HASHES)},
bits AS (SELECT DISTINCT id, hash % {LENGTH} AS pos FROM grams JOIN h USING (g)),
filters AS (SELECT id, list_sort(list(pos)) AS ps FROM bits GROUP BY id),
enc AS (SELECT min(id) AS nid, ps, len(ps) AS bits, count(*) AS node_count FROM filters GROUP BY ps)"""


def _q(x: str) -> str:
    return f"(-({LENGTH / HASHES}) * ln(1 - ({x}) / {LENGTH}.0))"


def _encoded_edges() -> str:
    union = "len(list_distinct(list_concat(a.ps, b.ps)))"
    return f"""ee AS (SELECT a.nid AS src, b.nid AS dst, 2 * greatest(0, {_q('a.bits')} + {_q('b.bits')} - {_q(union)}) / ({_q('a.bits')} + {_q('b.bits')}) AS weight FROM enc a JOIN enc b ON a.nid < b.nid)"""


def _keys() -> str:
    one = lambda p: " || ".join(f"CASE WHEN list_contains(ps, {x}) THEN '1' ELSE '0' END" for x in p)
    return "keys AS (" + " UNION ALL ".join(f"SELECT nid, {i}::BIGINT AS pass, {one(p)} AS blk FROM enc" for i, p in enumerate(PASSES)) + ")"


_COMPONENTS = """reach AS (SELECT v AS nid, v AS m FROM deg UNION SELECT reach.nid, sym.n FROM reach JOIN sym ON sym.v = reach.m),
comps AS (SELECT nid, min(m) AS comp FROM reach GROUP BY nid),
sized AS (SELECT nid, comp, count(*) OVER (PARTITION BY comp) AS comp_size FROM comps)"""

_BETWEEN = """dist AS (SELECT v AS s, v AS t, 0 AS d FROM deg UNION SELECT dist.s, sym.n, d + 1 FROM dist JOIN sym ON sym.v = dist.t WHERE d < 12),
near AS (SELECT s, t, min(d) AS d FROM dist GROUP BY s, t),
walks AS (SELECT v AS s, v AS t, 0 AS d, 1.0::DOUBLE AS c FROM deg UNION ALL SELECT w.s, sym.n, w.d + 1, sum(w.c) FROM walks w JOIN sym ON sym.v = w.t JOIN near ON near.s = w.s AND near.t = sym.n AND near.d = w.d + 1 GROUP BY w.s, sym.n, w.d + 1),
betw AS (SELECT deg.v AS nid, coalesce(b, 0) * 2 / ((SELECT count(*) FROM deg) - 1) / ((SELECT count(*) FROM deg) - 2) AS betw FROM deg LEFT JOIN (
  SELECT x.t AS v, sum(x.c * y.c / z.c) AS b FROM walks x JOIN walks y ON x.t = y.s JOIN walks z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s < y.t AND x.s <> x.t AND y.t <> y.s GROUP BY x.t) q USING (v))"""

_EGO = """ego AS (SELECT deg.v AS nid, deg + coalesce(t, 0) AS ego_edges, (deg + coalesce(t, 0)) / ((deg + 1) / 2.0 * deg) AS ego_dens FROM deg LEFT JOIN (
  SELECT a.v, count(*) // 2 AS t FROM sym a JOIN sym b ON a.v = b.v JOIN sym c ON c.v = a.n AND c.n = b.n GROUP BY a.v) q USING (v))"""

_HOPS = """hop1 AS (SELECT v AS nid, n FROM sym UNION SELECT v, v FROM deg),
hop2 AS (SELECT DISTINCT a.nid, b.n FROM hop1 a JOIN hop1 b ON b.nid = a.n)"""


def _bins(least: int) -> str:
    """Bins of a histogram: one for every power of two up to the largest degree, and `least` at least."""
    return f"(SELECT greatest({least}, floor(log2(max(deg)))::BIGINT + 1) FROM deg)"


def _histogram(hop: str, bins: int) -> str:
    return f"SELECT g.nid, d, count(n) FILTER (WHERE floor(log2(deg.deg)) = d)::DOUBLE AS x FROM (SELECT nid, n FROM {hop}) g JOIN deg ON deg.v = g.n, (SELECT unnest(range({_bins(bins)})) AS d) GROUP BY g.nid, d"


_STATS = "stats AS (SELECT v AS nid, count(*) AS deg, max(weight) AS wmax, min(weight) AS wmin, avg(weight) AS wavg, stddev_pop(weight) AS wstd FROM sym GROUP BY v)"
_VECTORS = f"{_STATS}, vec AS (SELECT nid, unnest([0, 1, 2, 3])::BIGINT AS d, unnest([deg::DOUBLE, wmax, wmin, wavg]) AS x FROM stats)"

_SIDES = """u AS (SELECT vec_id AS nid, embedding::DOUBLE[] AS emb, label FROM embeddings WHERE vec_id % 2 = 0),
v AS (SELECT vec_id AS nid, embedding::DOUBLE[] AS emb, label FROM embeddings WHERE vec_id % 2 = 1)"""
_PAIRS = f"{_SIDES}, pairs AS (SELECT * FROM (SELECT u.nid AS u, v.nid AS v, list_cosine_similarity(u.emb, v.emb) AS cos FROM u, v) WHERE cos >= {COSINE})"
_SCORED = f"""{_PAIRS},
sums AS (SELECT *, sum(cos) OVER (PARTITION BY u) AS sx, count(*) OVER (PARTITION BY u) AS cx, sum(cos) OVER (PARTITION BY v) AS sy, count(*) OVER (PARTITION BY v) AS cy FROM pairs),
conf AS (SELECT u, v, cos, CASE WHEN cx + cy <= 2 THEN 1.5 ELSE cos * (cx + cy - 2) / (sx + sy - 2 * cos) END AS sim_conf, 1.0 / (cx + cy - 1) AS degree_conf FROM sums),
lim AS (SELECT min(cos) AS a0, max(cos) - min(cos) AS b0, min(sim_conf) AS a1, max(sim_conf) - min(sim_conf) AS b1, min(degree_conf) AS a2, max(degree_conf) - min(degree_conf) AS b2 FROM conf),
scored AS (SELECT u, v, cos, sim_conf, degree_conf, CASE WHEN b0 > 1e-12 THEN 0.6 * (cos - a0) / b0 ELSE 0 END + CASE WHEN b1 > 1e-12 THEN 0.3 * (sim_conf - a1) / b1 ELSE 0 END + CASE WHEN b2 > 1e-12 THEN 0.1 * (degree_conf - a2) / b2 ELSE 0 END AS score FROM conf, lim)"""
_BEST = """ranked AS (SELECT u, v, score, row_number() OVER (PARTITION BY u ORDER BY round(score, 12) DESC, u, v) AS ru, row_number() OVER (PARTITION BY v ORDER BY round(score, 12) DESC, u, v) AS rv FROM scored),
best AS (SELECT row_number() OVER (ORDER BY round(score, 12) DESC, u, v) AS rank, u, v, score FROM ranked WHERE ru = 1 AND rv = 1 QUALIFY rank <= 100)"""


def _planes() -> str:
    plane = lambda p: "[" + ", ".join(map(repr, np.random.default_rng([PLANE_SEED, p]).standard_normal(64).tolist())) + "]"
    one = lambda x: " || ".join(f"CASE WHEN list_dot_product(emb, {plane(p)}::DOUBLE[]) >= 0 THEN '1' ELSE '0' END" for p in x)
    side = lambda s: " UNION ALL ".join(f"SELECT nid, {i}::BIGINT AS pass, {one(x)} AS blk FROM {s}" for i, x in enumerate(PLANE_PASSES))
    return f"ub AS ({side('u')}), vb AS ({side('v')})"


#: The base64 of a filter by its set positions (id, pos), and of empty ones, bits from the lowest.
_BASE64 = f"""bytes AS (SELECT p_partkey AS id, i, coalesce(sum(1 << (pos % 8)::INT), 0)::INT AS b FROM part CROSS JOIN (SELECT unnest(range({LENGTH // 8})) AS i) LEFT JOIN bits ON bits.id = p_partkey AND pos // 8 = i GROUP BY ALL),
keys64 AS (SELECT id, base64(unhex(string_agg(printf('%02X', b), '' ORDER BY i))) AS v_key FROM bytes GROUP BY id)"""

_HASH_COUNT = f"(SELECT round_even(ln(1 - (SELECT avg(bits) FROM enc) / {LENGTH}.0) / ln(1 - 1.0 / {LENGTH}) / (SELECT avg(n) FROM sets), 0)::BIGINT)"


def _both_sides(threshold: float) -> str:
    """gnodes(nid, side, q) and edges(src, dst, weight) of the graph of both sides, in components of three nodes and more.

    Ids are twice the row's for plain nodes, and one more for encoded ones.
    """
    return f"""{_edges()}, {_hashes(HASHES)},
bits AS (SELECT DISTINCT id, hash % {LENGTH} AS pos FROM grams JOIN h USING (g)),
filters AS (SELECT p_partkey AS id, list_sort(coalesce(list(pos) FILTER (WHERE pos IS NOT NULL), [])) AS ps FROM part LEFT JOIN bits ON bits.id = p_partkey GROUP BY p_partkey),
enc AS (SELECT min(id) AS nid, ps, len(ps) AS bits, count(*) AS node_count FROM filters GROUP BY ps),
{_encoded_edges()},
gnodes AS (SELECT 2 * nid AS nid, 'u' AS side, n AS q FROM nodes UNION ALL SELECT 2 * nid + 1, 'v', -({LENGTH}.0 / {_HASH_COUNT}) * ln(1 - bits / {LENGTH}.0) FROM enc),
every AS (SELECT 2 * src AS src, 2 * dst AS dst, weight FROM edges UNION ALL SELECT 2 * src + 1, 2 * dst + 1, weight FROM ee WHERE weight >= {threshold}),
sym0 AS (SELECT src AS v, dst AS n FROM every UNION ALL SELECT dst, src FROM every),
reach AS (SELECT DISTINCT v AS nid, v AS m FROM sym0 UNION SELECT reach.nid, sym0.n FROM reach JOIN sym0 ON sym0.v = reach.m),
sized AS (SELECT nid, count(*) OVER (PARTITION BY comp) AS comp_size FROM (SELECT nid, min(m) AS comp FROM reach GROUP BY nid)),
gedges AS (SELECT every.* FROM every JOIN sized ON nid = src WHERE comp_size >= 3)"""


def _wave(edges: str, points: list[float], scales: str, order: int, weighted: bool = True) -> str:
    """heat(s, i, j, x) and wave(nid, d, x) of the graph edges(src, dst, weight); scales: an expression of n, the number of nodes.

    The recurrence T(k+1) = 2 (L - I) T(k) - T(k-1) on dense columns, with the coefficients of exp(-s (x + 1)).
    """
    weight = "weight" if weighted else "1.0::DOUBLE"
    return f"""ws AS (SELECT src AS v, dst AS n, {weight} AS w FROM {edges} UNION ALL SELECT dst, src, {weight} FROM {edges}),
wd AS (SELECT v, sum(w) AS d FROM ws GROUP BY v),
wn AS (SELECT count(*)::DOUBLE AS n FROM wd),
lap AS (SELECT ws.v AS i, ws.n AS m, -w / sqrt(a.d * b.d) AS x FROM ws JOIN wd a ON a.v = ws.v JOIN wd b ON b.v = ws.n),
cheb AS (
  SELECT 1 AS k, i.v AS i, j.v AS j, coalesce(lap.x, 0)::DOUBLE AS t, (i.v = j.v)::INT::DOUBLE AS p FROM wd i CROSS JOIN wd j LEFT JOIN lap ON lap.i = i.v AND lap.m = j.v
  UNION ALL
  SELECT any_value(c.k) + 1, lap.i, c.j, 2 * sum(lap.x * c.t) - any_value(o.p), any_value(o.t)
  FROM cheb c JOIN lap ON lap.m = c.i JOIN cheb o ON o.i = lap.i AND o.j = c.j WHERE c.k < {order} GROUP BY lap.i, c.j),
tk AS (SELECT k, i, j, t FROM cheb UNION ALL SELECT 0, i, j, p FROM cheb WHERE k = 1),
sc AS (SELECT generate_subscripts(l, 1) AS s, unnest(l) AS scale FROM (SELECT {scales} AS l FROM wn)),
ats AS (SELECT (2 * q - 1) * pi() / {2 * order} AS a FROM (SELECT unnest(range(1, {order + 1})) AS q)),
coef AS (SELECT s, k, 2.0 / {order} * sum(cos(k * a) * exp(-scale * (cos(a) + 1))) / CASE WHEN k = 0 THEN 2 ELSE 1 END AS c FROM sc, ats, (SELECT unnest(range({order + 1})) AS k) GROUP BY s, k),
heat AS (SELECT s, i, j, CASE WHEN sum(c * t) > 1e-4 / any_value(wn.n) THEN sum(c * t) ELSE 0 END AS x FROM tk JOIN coef USING (k), wn GROUP BY s, i, j),
pts AS (SELECT generate_subscripts(l, 1) AS q, unnest(l) AS t FROM (SELECT {points!r}::DOUBLE[] AS l)),
wave AS (
  SELECT j AS nid, ((s - 1) * {2 * len(points)} + 2 * (q - 1) + e)::BIGINT AS d, CASE WHEN e = 0 THEN avg(cos(t * x)) ELSE avg(sin(t * x)) END AS x
  FROM heat, pts, (SELECT unnest([0, 1]) AS e) GROUP BY j, s, q, e)"""


_AUTO = "[-ln(0.95) * sqrt(n / 2), -ln(0.80) * sqrt(n / 2)]"


def _linspace(low: float, high: float, n: int) -> list[float]:
    return np.linspace(low, high, n).tolist()


def _matching(name: str, pairs: str) -> str:
    """{name}(k, tp) from a query for pairs (u, v, cos): rescored, the mutual best ones, and their true ones of the first k."""
    n = name
    return f"""{n}p AS ({pairs}),
{n}s AS (SELECT *, sum(cos) OVER (PARTITION BY u) AS sx, count(*) OVER (PARTITION BY u) AS cx, sum(cos) OVER (PARTITION BY v) AS sy, count(*) OVER (PARTITION BY v) AS cy FROM {n}p),
{n}c AS (SELECT u, v, cos, CASE WHEN cx + cy <= 2 THEN 1.5 ELSE cos * (cx + cy - 2) / (sx + sy - 2 * cos) END AS sim_conf, 1.0 / (cx + cy - 1) AS degree_conf FROM {n}s),
{n}l AS (SELECT min(cos) AS a0, max(cos) - min(cos) AS b0, min(sim_conf) AS a1, max(sim_conf) - min(sim_conf) AS b1, min(degree_conf) AS a2, max(degree_conf) - min(degree_conf) AS b2 FROM {n}c),
{n}o AS (SELECT u, v, round(CASE WHEN b0 > 1e-12 THEN 0.6 * (cos - a0) / b0 ELSE 0 END + CASE WHEN b1 > 1e-12 THEN 0.3 * (sim_conf - a1) / b1 ELSE 0 END + CASE WHEN b2 > 1e-12 THEN 0.1 * (degree_conf - a2) / b2 ELSE 0 END, 12) AS score FROM {n}c, {n}l),
{n}r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, u, v) AS ru, row_number() OVER (PARTITION BY v ORDER BY score DESC, u, v) AS rv FROM {n}o),
{n}b AS (SELECT row_number() OVER (ORDER BY score DESC, u, v) AS rank, u, v FROM {n}r WHERE ru = 1 AND rv = 1),
{n} AS (SELECT k::BIGINT AS k, count(*) FILTER (WHERE rank <= k AND u + 1 = v) AS tp FROM {n}b RIGHT JOIN (SELECT unnest({list(KS)}) AS k) ON true GROUP BY k)"""


def _alignment() -> str:
    scaled = lambda t: f"SELECT nid, d, CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END AS x FROM (SELECT *, avg(x) OVER (PARTITION BY d) AS m, stddev_pop(x) OVER (PARTITION BY d) AS s FROM {t})"
    unit = lambda t: f"SELECT nid, d, CASE WHEN l > 0 THEN x / l ELSE 0 END AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY nid)) AS l FROM {t})"
    cosine = lambda t: f"SELECT a.nid AS u, b.nid AS v, sum(a.x * b.x) AS cos FROM {t} a JOIN {t} b USING (d) WHERE a.nid % 2 = 0 AND b.nid % 2 = 1 GROUP BY a.nid, b.nid"
    tail = f"{_both_sides(THRESHOLD)}, sym AS (SELECT src AS v, dst AS n, weight FROM gedges UNION ALL SELECT dst, src, weight FROM gedges), deg1 AS (SELECT v, count(*) AS deg FROM sym GROUP BY v)"
    # the builders below read sym and deg: those of the whole graph
    tail = tail.replace("sym AS (SELECT src AS v, dst AS n, weight FROM edges UNION", "symp AS (SELECT src AS v, dst AS n, weight FROM edges UNION", 1).replace("deg AS (SELECT v, count(*) AS deg FROM sym GROUP BY v),", "", 1).replace("deg1 AS", "deg AS")
    # more bins than degrees are columns of zeros, which scaling leaves at zero
    return f"""WITH RECURSIVE {tail}, {_STATS}, {_EGO}, {_HOPS.split(chr(10))[0].rstrip(',')},
vec AS (
  SELECT stats.nid, unnest(range(9))::BIGINT AS d, unnest([q, stats.deg::DOUBLE, wmax, wmin, wavg, wstd, ego_edges::DOUBLE, ego_dens, stats.deg / (comp_size - 1.0)]) AS x
  FROM stats JOIN gnodes USING (nid) JOIN ego USING (nid) JOIN sized USING (nid)
  UNION ALL SELECT nid, d + 9, x FROM ({_histogram('hop1', 12)})),
{_wave('gedges', _linspace(0, 100, 25), _AUTO, 30)},
f0 AS ({scaled('vec')}), w0 AS ({scaled('wave')}), f1 AS ({unit('f0')}), w1 AS ({unit('w0')}), fc AS ({cosine('f1')}), wc AS ({cosine('w1')}),
both_ AS (SELECT u, v, fc.cos AS c0, wc.cos AS c1 FROM fc JOIN wc USING (u, v)),
{_matching('m0', 'SELECT u, v, cos FROM fc WHERE cos >= 0.5')},
{_matching('m1', 'SELECT u, v, c1 AS cos FROM both_ WHERE c1 >= 0.5')},
{_matching('m2', 'SELECT u, v, 0.5 * c0 + 0.5 * c1 AS cos FROM both_ WHERE 0.5 * c0 + 0.5 * c1 >= 0.5')}
SELECT technique, weight, k, tp, {r('tp / k', 'precision')} FROM (
  SELECT 'features' AS technique, NULL::DOUBLE AS weight, * FROM m0 UNION ALL SELECT 'graphwave', 1.0, * FROM m1 UNION ALL SELECT 'graphwave', 0.5, * FROM m2)"""


def _texts(values: dict, names: list[str]) -> str:
    """Columns of text, as a result row holds them."""
    return ", ".join(f"'{str(values[c]).replace(chr(39), chr(39) * 2)}' AS {c}" if values.get(c) is not None else f"NULL::VARCHAR AS {c}" for c in names)


def _precisions() -> str:
    return f"p AS (SELECT k, round(count(*) FILTER (WHERE rank <= k AND a.label = b.label) / k, 6) AS p FROM best JOIN u a ON a.nid = best.u JOIN v b ON b.nid = best.v, (SELECT unnest({list(KS)}) AS k) GROUP BY k), " + "wide AS (SELECT " + ", ".join(f"max(p) FILTER (WHERE k = {k}) AS precision_{k}" for k in KS) + " FROM p)"


def _technique_rows() -> str:
    every = list(dict.fromkeys(c for t in TECHNIQUE_VALUES for c in TECHNIQUE_COLUMNS[t]))
    rows = (f"SELECT '{t}' AS technique, {_texts(SINK_VALUES, COMMON + PARAMETERS)}, {_texts(more, every)}" for t, more in TECHNIQUE_VALUES.items())
    return " UNION ALL ".join(rows)


def _mixtures() -> str:
    return f"""WITH {_SIDES}, c AS (SELECT u.nid AS u, v.nid AS v, list_cosine_similarity(u.emb[1:32], v.emb[1:32]) AS c0, list_cosine_similarity(u.emb[33:64], v.emb[33:64]) AS c1 FROM u, v),
m AS (SELECT share, u, v, share * c0 + (1 - share) * c1 AS cos FROM c, (SELECT unnest([0.0, 0.25, 0.75]::DOUBLE[]) AS share)) SELECT share, u, v, {r('cos', 'cos')} FROM m WHERE cos >= {COSINE}"""


_META = """SELECT r_regionkey::BIGINT AS k, r_regionkey * 100 - 100 AS record_count, ['0.0', '0.1', '0.2', '0.3', '0.4'][r_regionkey + 1] AS removed, r_regionkey AS comp, ['fast', 'egonet1', 'egonet2', 'all'][r_regionkey % 4 + 1] AS features,
  r_regionkey % 2 = 0 AS counted, ['', 'minmax', 'standard'][r_regionkey % 3 + 1] AS scaler, r_regionkey % 2 AS c, 8 * (r_regionkey % 2) AS s FROM region"""

_ROUNDED = r("weight", "weight")

SQL = {
    "head_slice": "SELECT p_partkey - 1 AS row_idx, p_name FROM part WHERE p_partkey - 1 < 50",
    "tail_slice": "SELECT p_partkey - 1 AS row_idx, p_name FROM part WHERE p_partkey - 1 > (SELECT max(p_partkey) - 1 FROM part) - 50",
    "dedup_node_count": f"WITH {_nodes()} SELECT nid, key, n AS qgrams_count, node_count FROM nodes",
    "sample_exact": "SELECT p_partkey AS row_idx, p_name FROM part ORDER BY md5('3:' || p_partkey), p_partkey LIMIT (SELECT round(0.8 * count(*))::BIGINT FROM part)",
    "csv_scan": "SELECT p_partkey AS row_idx, p_name || chr(10) || '\"' || p_brand || '\", ' AS name, CASE WHEN p_partkey % 3 <> 0 THEN coalesce(p_type, '') ELSE '' END AS kind FROM part",
    "dataset_names": f"""SELECT k AS region, 'c' || record_count || '_t0.4' || CASE WHEN comp > 0 THEN '_comp' || comp ELSE '' END || '_r' || removed || 'e0.25' || CASE WHEN s > 0 THEN '_lshc' || c || '_lshs' || s ELSE '' END
  || '_' || features || CASE WHEN counted THEN '_nodeCount' ELSE '' END || CASE scaler WHEN 'minmax' THEN '_minmax' WHEN 'standard' THEN '_std' ELSE '' END AS name, record_count::VARCHAR AS record_count, '0.4' AS threshold, removed AS removed_plain,
  '0.25' AS removed_encoded, comp::VARCHAR AS min_comp_size, features AS node_features, CASE WHEN counted THEN 'True' ELSE 'False' END AS node_count, scaler, (CASE WHEN s > 0 THEN c ELSE 0 END)::VARCHAR AS lsh_count, s::VARCHAR AS lsh_size FROM ({_META})""",
    "ground_truth": f"WITH {_filters()}, {_BASE64}, firsts AS (SELECT min(id) AS nid, v_key FROM keys64 GROUP BY v_key) SELECT nodes.nid, key AS u_key, v_key FROM nodes JOIN firsts USING (nid)",
    "ground_truth_all_rows": f"WITH {_filters()}, {_BASE64} SELECT min(id) AS nid, key AS u_key, v_key FROM sets JOIN keys64 USING (id) GROUP BY key, v_key",
    "side_ids": f"WITH {_nodes()} SELECT nid, 'u' AS side, 'u_' || key AS id, key AS stripped FROM nodes",
    "bigrams": f"WITH {_nodes()} SELECT id AS row_idx, g AS gram FROM grams",
    "bigrams_padded": f"WITH {_nodes(padding=True)} SELECT id AS row_idx, g AS gram FROM grams",
    "murmur_positions": f"WITH {_nodes()}, {_hashes(HASHES)} SELECT g AS gram, seed, CASE WHEN hash >= 2147483648 THEN hash - {_M} ELSE hash END AS hash, hash % {LENGTH} AS pos FROM h",
    "bloom_positions": f"WITH {_filters()} SELECT id AS row_idx, pos FROM bits",
    "bloom_popcount": f"WITH {_filters()} SELECT id AS row_idx, count(*) AS bits FROM bits GROUP BY id",
    "bloom_decode": f"WITH {_filters()} SELECT id AS row_idx, pos FROM bits",
    "hash_count_estimate": f"WITH {_filters()} SELECT {_HASH_COUNT} AS hashes",
    "qgram_estimates": f"WITH {_filters()} SELECT nid, bits, {r(_q('bits'), 'qgrams_count')}, node_count FROM enc",
    "sim_edges_plain": f"WITH {_edges()} SELECT src, dst, {_ROUNDED} FROM edges",
    "sim_edges_wide": f"WITH {_edges('p_name', 'p_type')} SELECT src, dst, {_ROUNDED} FROM edges",
    "sim_edges_all_pairs": f"WITH {_nodes()}, c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) GROUP BY ALL) SELECT a.nid AS src, b.nid AS dst, {r('CASE WHEN a.n + b.n > 0 THEN 2.0 * coalesce(c, 0) / (a.n + b.n) ELSE 0 END', 'weight')} FROM nodes a JOIN nodes b ON a.nid < b.nid LEFT JOIN c ON c.x = a.nid AND c.y = b.nid",
    "sim_edges_encoded": f"WITH {_filters()}, {_encoded_edges()} SELECT src, dst, {_ROUNDED} FROM ee WHERE weight >= {THRESHOLD}",
    "lsh_block_keys": f"WITH {_filters()}, {_keys()} SELECT nid, pass, blk FROM keys",
    "block_stats": f"WITH {_filters()}, {_keys()}, n AS (SELECT pass, blk, count(*) AS n FROM keys GROUP BY ALL) SELECT count(*) AS blocks, min(n) AS least, max(n) AS most, {r('avg(n)', 'mean')}, {r('median(n)', 'median')} FROM n",
    "sim_edges_blocked": f"WITH {_filters()}, {_keys()}, {_encoded_edges()} SELECT src, dst, {_ROUNDED} FROM ee WHERE weight >= {THRESHOLD} AND EXISTS (SELECT 1 FROM keys a JOIN keys b USING (pass, blk) WHERE a.nid = src AND b.nid = dst)",
    "components": f"WITH RECURSIVE {_edges()}, {_COMPONENTS} SELECT nid, comp FROM comps",
    "filter_small_components": f"WITH RECURSIVE {_edges()}, {_COMPONENTS} SELECT src, dst, {_ROUNDED} FROM edges JOIN sized ON nid = src WHERE comp_size >= 4",
    "edge_weight_stats": f"WITH {_edges('p_name', 'p_type')}, {_STATS} SELECT nid, deg, {r('wmax', 'wmax')}, {r('wmin', 'wmin')}, {r('wavg', 'wavg')}, {r('wstd', 'wstd')} FROM stats",
    "degree_centrality": f"WITH RECURSIVE {_edges()}, {_COMPONENTS} SELECT nid, {r('deg / (comp_size - 1.0)', 'degcentr')} FROM deg JOIN sized ON nid = v",
    "egonet": f"WITH {_edges('p_name', 'p_type')}, {_EGO} SELECT nid, ego_edges, {r('ego_dens', 'ego_dens')} FROM ego",
    "histo_1hop": f"WITH {_edges('p_name', 'p_type')}, {_HOPS} {_histogram('hop1', 8)}",
    "histo_2hop": f"WITH {_edges('p_name', 'p_type')}, {_HOPS} {_histogram('hop2', 8)}",
    "betweenness": f"WITH RECURSIVE {_edges()}, {_BETWEEN} SELECT nid, {r('betw', 'betw')} FROM betw",
    "features_all": f"""WITH RECURSIVE {_edges().replace('edges AS (', 'every AS (', 1).replace('FROM edges', 'FROM every').replace('deg AS (', 'deg0 AS (', 1).replace('sym AS (', 'sym0 AS (', 1).replace('FROM sym ', 'FROM sym0 ')},
reach AS (SELECT v AS nid, v AS m FROM deg0 UNION SELECT reach.nid, sym0.n FROM reach JOIN sym0 ON sym0.v = reach.m),
sized AS (SELECT nid, count(*) OVER (PARTITION BY comp) AS comp_size FROM (SELECT nid, min(m) AS comp FROM reach GROUP BY nid)),
edges AS (SELECT every.* FROM every JOIN sized ON nid = src WHERE comp_size >= 3),
sym AS (SELECT src AS v, dst AS n, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS (SELECT v, count(*) AS deg FROM sym GROUP BY v),
{_STATS}, {_EGO}, {_HOPS}, {_BETWEEN},
h1 AS ({_histogram('hop1', 3)}), h2 AS ({_histogram('hop2', 3)}),
f AS (SELECT stats.nid, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])::BIGINT AS d, unnest([nodes.n, stats.deg::DOUBLE, wmax, wmin, wavg, wstd, ego_edges::DOUBLE, ego_dens, betw, stats.deg / (comp_size - 1.0)]) AS x
  FROM stats JOIN nodes USING (nid) JOIN ego USING (nid) JOIN betw USING (nid) JOIN sized USING (nid))
SELECT nid, d, {r('x', 'x')} FROM (SELECT * FROM f UNION ALL SELECT nid, d + 10, x FROM h1 UNION ALL SELECT nid, d + 10 + {_bins(3)}, x FROM h2)""",
    "scale_standard": f"WITH {_edges()}, {_VECTORS} SELECT nid, d, {r('CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END', 'x')} FROM (SELECT *, avg(x) OVER (PARTITION BY d) AS m, stddev_pop(x) OVER (PARTITION BY d) AS s FROM vec)",
    "scale_minmax": f"WITH {_edges()}, {_VECTORS} SELECT nid, d, {r('CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END', 'x')} FROM (SELECT *, min(x) OVER (PARTITION BY d) AS m, max(x) OVER (PARTITION BY d) - min(x) OVER (PARTITION BY d) AS s FROM vec)",
    "sage_mean_propagate": f"WITH {_edges()}, {_VECTORS} SELECT v AS nid, d, {r('avg(x)', 'x')} FROM sym JOIN vec ON vec.nid = sym.n GROUP BY v, d",
    "gcn_propagate": f"WITH {_edges()}, {_VECTORS}, arcs AS (SELECT v, n FROM sym UNION ALL SELECT v, v FROM deg) SELECT arcs.v AS nid, d, {r('sum(x / sqrt((a.deg + 1) * (b.deg + 1)))', 'x')} FROM arcs JOIN vec ON vec.nid = arcs.n JOIN deg a ON a.v = arcs.v JOIN deg b ON b.v = arcs.n GROUP BY arcs.v, d",
    "heat_kernel": f"WITH RECURSIVE {_edges()}, {_wave('edges', [0.0], '[1.0::DOUBLE]', 30)} SELECT i AS src, j AS dst, {r('x', 'value')} FROM heat WHERE x > 0",
    "graphwave_embedding": f"WITH RECURSIVE {_edges()}, {_wave('edges', _linspace(0, 100, 50), _AUTO, 30)} SELECT nid, d, {r('x', 'x')} FROM wave",
    "graphwave_unweighted": f"WITH RECURSIVE {_edges()}, {_wave('edges', _linspace(0, 50, 10), '[1.0, 10.0, 25.0, 50.0]::DOUBLE[]', 20, False)} SELECT nid, d, {r('x', 'x')} FROM wave",
    "weighted_cosine_lsh": f"WITH {_SIDES}, {_planes()}, c AS (SELECT u.nid AS u, v.nid AS v, 0.3 * list_cosine_similarity(u.emb[1:32], v.emb[1:32]) + 0.7 * list_cosine_similarity(u.emb[33:64], v.emb[33:64]) AS cos FROM u, v) SELECT u, v, {r('cos', 'cos')} FROM c WHERE cos >= {COSINE} AND EXISTS (SELECT 1 FROM ub JOIN vb USING (pass, blk) WHERE ub.nid = u AND vb.nid = v)",
    "channel_mixtures": _mixtures(),
    "hyperplane_buckets": f"WITH {_SIDES}, {_planes()} SELECT nid, pass, blk FROM ub",
    "cosine_candidates": f"WITH {_PAIRS} SELECT u, v, {r('cos', 'cos')} FROM pairs",
    "cosine_candidates_lsh": f"WITH {_PAIRS}, {_planes()} SELECT u, v, {r('cos', 'cos')} FROM pairs WHERE EXISTS (SELECT 1 FROM ub JOIN vb USING (pass, blk) WHERE ub.nid = u AND vb.nid = v)",
    "weighted_cosine": f"WITH {_SIDES}, c AS (SELECT u.nid AS u, v.nid AS v, 0.3 * list_cosine_similarity(u.emb[1:32], v.emb[1:32]) + 0.7 * list_cosine_similarity(u.emb[33:64], v.emb[33:64]) AS cos FROM u, v) SELECT u, v, {r('cos', 'cos')} FROM c WHERE cos >= {COSINE}",
    "rescore_edges": f"WITH {_SCORED} SELECT u, v, {r('cos', 'cos')}, {r('sim_conf', 'sim_conf')}, {r('degree_conf', 'degree_conf')}, {r('score', 'score')} FROM scored",
    "match_shm": f"WITH {_SCORED}, {_BEST} SELECT rank, u, v, {r('score', 'score')} FROM best",
    "match_smm": f"""WITH RECURSIVE {_SCORED},
listed AS (SELECT row_number() OVER (ORDER BY round(score, 12) DESC, u, v) AS i, u, v, score FROM scored),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS us, []::BIGINT[] AS vs
  UNION ALL
  SELECT l.i, CASE WHEN list_contains(us, l.u) OR list_contains(vs, l.v) THEN us ELSE list_append(us, l.u) END, CASE WHEN list_contains(us, l.u) OR list_contains(vs, l.v) THEN vs ELSE list_append(vs, l.v) END
  FROM walk JOIN listed l ON l.i = walk.i + 1),
last AS (SELECT us, vs FROM walk ORDER BY i DESC LIMIT 1),
pairsof AS (SELECT unnest(us) AS u, unnest(vs) AS v FROM last)
SELECT row_number() OVER (ORDER BY round(score, 12) DESC, u, v) AS rank, u, v, {r('score', 'score')} FROM pairsof JOIN scored USING (u, v) QUALIFY rank <= 100""",
    "true_matches": f"WITH {_SCORED}, {_BEST} SELECT sum((a.label = b.label)::INT)::BIGINT AS tp FROM best JOIN u a ON a.nid = best.u JOIN v b ON b.nid = best.v",
    "precision_at_k": f"WITH {_SCORED}, {_BEST} SELECT k::BIGINT AS k, count(*) FILTER (WHERE rank <= k AND a.label = b.label) AS tp, {r('count(*) FILTER (WHERE rank <= k AND a.label = b.label) / k', 'precision')} FROM best JOIN u a ON a.nid = best.u JOIN v b ON b.nid = best.v, (SELECT unnest({list(KS)}) AS k) GROUP BY k",
    "result_sink": f"WITH {_SCORED}, {_BEST}, {_precisions()} SELECT {_texts(SINK_VALUES, COMMON)}, wide.*, {_texts(SINK_VALUES, PARAMETERS)} FROM wide, range(2)",
    "result_sink_techniques": f"WITH {_SCORED}, {_BEST}, {_precisions()} SELECT * FROM ({_technique_rows()}), wide",
    "timing_sink": f"SELECT k::BIGINT AS record_count, {THRESHOLD}::DOUBLE AS threshold, name AS feature_set, t::DOUBLE AS time FROM (VALUES (0, 'fast', 0.0), (1, 'all', 1.5), (2, 'fast', 3.0)) AS v(k, name, t)",
    "graph_store": f"WITH RECURSIVE {_both_sides(THRESHOLD)} SELECT CASE WHEN src % 2 = 0 THEN 'u' ELSE 'v' END AS side, src // 2 AS src, dst // 2 AS dst, {_ROUNDED} FROM gedges",
    "alignment_run": _alignment(),
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
