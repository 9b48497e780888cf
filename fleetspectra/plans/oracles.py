"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written against the tables, not against the library: distances come from an n x n self-join, k-medoids
from unrolled rounds.
"""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

USAGE = """usage AS (
  SELECT 'V' || lpad(cast(o_custkey AS varchar), 8, '0') AS vin,
         cast(o_custkey % 15 + 1 AS int) AS sales_group,
         cast(floor(l_quantity) AS bigint) AS v_lo,
         cast(floor(l_extendedprice / 1000) AS bigint) * 1000 AS w_lo,
         cast(round(l_discount * 100) AS bigint) AS g_lo,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
OUTLIERS = """outliers AS (
  SELECT 'V' || lpad(cast(c_custkey AS varchar), 8, '0') AS vin FROM customer WHERE c_acctbal < 0)"""
_LO = {"velocity": "v_lo", "weight": "w_lo", "gradient": "g_lo"}
_WIDTH = {"velocity": 1, "weight": 1000, "gradient": 1}
_FIRST = {"velocity": "0.5", "weight": "12500.0", "gradient": "0.5"}
_BIN = {"velocity": "lo", "weight": "(lo - 12000) // 1000", "gradient": "lo"}
_BINS = {
    "velocity": "(SELECT max(lo) + 1 FROM clean_velocity)",
    "weight": "38",
    "gradient": "10",
}


def clean(signal: str) -> str:
    """Raw and cleaned spectra of a signal, with the lower edge as ``lo``."""
    return f"""raw_{signal} AS (
  SELECT vin, sales_group, {_LO[signal]} AS lo, cast(count(*) AS double) AS count
  FROM usage GROUP BY ALL),
clean_{signal} AS (
  SELECT * FROM raw_{signal} WHERE vin NOT IN (SELECT vin FROM outliers))"""


def dense(signal: str) -> str:
    """``d_{signal}``: vin, sales_group, bin, center, m, p, cdf on the whole grid."""
    return f"""{clean(signal)},
m_{signal} AS (
  SELECT vin, sales_group, {_BIN[signal]} AS bin, sum(count) AS m FROM clean_{signal}
  WHERE {_BIN[signal]} BETWEEN 0 AND {_BINS[signal]} - 1 AND lo >= 0 GROUP BY ALL),
t_{signal} AS (
  SELECT vin, sales_group, sum(m) AS total FROM m_{signal} GROUP BY ALL HAVING sum(m) > 0),
d_{signal} AS MATERIALIZED (
  SELECT t.vin, t.sales_group, cast(g.bin AS int) AS bin,
         {_FIRST[signal]}::double + g.bin * {_WIDTH[signal]} AS center,
         coalesce(m.m, 0) AS m, coalesce(m.m, 0) / t.total AS p,
         sum(coalesce(m.m, 0)) OVER (PARTITION BY t.vin ORDER BY g.bin) / t.total AS cdf
  FROM t_{signal} t
  CROSS JOIN (SELECT unnest(range({_BINS[signal]})) AS bin) g
  LEFT JOIN m_{signal} m ON m.vin = t.vin AND m.bin = g.bin)"""


def head(*parts: str) -> str:
    return "WITH " + ",\n".join([USAGE, OUTLIERS, *parts])


def points(signal: str) -> str:
    return f"{dense(signal)},\nc AS MATERIALIZED (SELECT vin AS v, bin AS b, cdf AS x FROM d_{signal})"


MATRIX = """dm AS MATERIALIZED (
  SELECT a.v AS i, b.v AS j, sum(abs(a.x - b.x)) AS d FROM c a JOIN c b ON a.b = b.b GROUP BY 1, 2)"""


def rounds(k: int, n: int = 16, tag: str = "") -> str:
    """k-medoids as n unrolled rounds; a converged round repeats itself. Labels end in ``lab{tag}``."""
    out = [
        f"""m{tag}_0 AS MATERIALIZED (
  SELECT i, cast(row_number() OVER (ORDER BY cost, i) - 1 AS int) AS l
  FROM (SELECT i, round(avg(d), 9) AS cost FROM dm GROUP BY i ORDER BY cost, i LIMIT {k}))"""
    ]

    def assign(t: int) -> str:
        return f"""(SELECT j, l FROM (
    SELECT dm.j, m.l, row_number() OVER (PARTITION BY dm.j ORDER BY round(dm.d, 9), m.l) AS rn
    FROM m{tag}_{t} m JOIN dm ON dm.i = m.i) WHERE rn = 1)"""

    for t in range(1, n + 1):
        out.append(f"a{tag}_{t} AS MATERIALIZED {assign(t - 1)}")
        out.append(
            f"""m{tag}_{t} AS MATERIALIZED (
  SELECT m.l, coalesce(best.i, m.i) AS i FROM m{tag}_{t - 1} m LEFT JOIN (
    SELECT l, i FROM (
      SELECT cost.l, cost.i, row_number() OVER (
        PARTITION BY cost.l ORDER BY cost.cost, (cost.i <> cur.i), cost.i) AS rn
      FROM (SELECT a.l, a.j AS i, round(avg(dm.d), 9) AS cost
            FROM a{tag}_{t} a JOIN dm ON dm.i = a.j JOIN a{tag}_{t} o ON o.j = dm.j AND o.l = a.l
            GROUP BY 1, 2) cost
      JOIN m{tag}_{t - 1} cur ON cur.l = cost.l) WHERE rn = 1) best ON best.l = m.l)"""
        )
    out.append(f"lab{tag} AS MATERIALIZED {assign(n)}")
    return ",\n".join(out)


def silhouettes(tag: str = "") -> str:
    """Per-vehicle silhouette ``sil{tag}(i, l, s)`` from labels and the matrix."""
    return f"""size{tag} AS (SELECT l, count(*) AS n FROM lab{tag} GROUP BY l),
sums{tag} AS (
  SELECT dm.i, o.l, sum(dm.d) AS t FROM dm JOIN lab{tag} o ON o.j = dm.j GROUP BY 1, 2),
ab{tag} AS (
  SELECT s.i, own.l, max(CASE WHEN s.l = own.l THEN z.n END) AS n,
         max(CASE WHEN s.l = own.l THEN s.t / nullif(z.n - 1, 0) END) AS a,
         min(CASE WHEN s.l <> own.l THEN s.t / z.n END) AS b
  FROM sums{tag} s JOIN lab{tag} own ON own.j = s.i JOIN size{tag} z ON z.l = s.l GROUP BY 1, 2),
sil{tag} AS (
  SELECT i, l, CASE WHEN n > 1 AND greatest(a, b) > 1e-9 THEN (b - a) / greatest(a, b)
                    ELSE 0 END AS s FROM ab{tag})"""


REPORT_K = {"velocity": 3, "weight": 2, "gradient": 2}


def clustered(signal: str, k: int | None = None) -> str:
    """``s_{signal}``: vin, sales_group, mean_center, cluster by k-medoids."""
    own = f"{MATRIX}, {rounds(k or REPORT_K[signal], 16, '_' + signal)}"
    own = re.sub(r"\bdm\b", f"dm_{signal}", own)
    own = re.sub(r"\bc ([ab])\b", rf"c_{signal} \1", own)
    return f"""{dense(signal)},
c_{signal} AS MATERIALIZED (SELECT vin AS v, bin AS b, cdf AS x FROM d_{signal}),
{own},
s_{signal} AS MATERIALIZED (
  SELECT vin, sales_group, mean_center, l AS cluster
  FROM (SELECT vin, sales_group, sum(p * center) AS mean_center FROM d_{signal} GROUP BY ALL)
  JOIN lab_{signal} ON j = vin)"""


ALL_CLUSTERS = ",\n".join(clustered(s) for s in ("velocity", "weight", "gradient"))
SUBPOP = f"""{ALL_CLUSTERS},
subpop AS MATERIALIZED (
  SELECT v.vin, v.sales_group,
         v.cluster AS cluster_wasserstein_velocity,
         CASE v.cluster WHEN 0 THEN 'Medium' WHEN 1 THEN 'High' WHEN 2 THEN 'Low' END AS cluster_velocity_text,
         w.cluster AS cluster_wasserstein_weight,
         CASE w.cluster WHEN 0 THEN 'High' WHEN 1 THEN 'Low' END AS cluster_weight_text,
         g.cluster AS cluster_wasserstein_gradient,
         CASE g.cluster WHEN 0 THEN 'Hilly' WHEN 1 THEN 'Flat' END AS cluster_gradient_text
  FROM s_velocity v JOIN s_weight w USING (vin, sales_group) JOIN s_gradient g USING (vin, sales_group)),
stats AS (
  SELECT vin, sales_group, avg(l_quantity) AS vehicle_speed_avg_driving_kmh,
         avg(l_extendedprice) AS gc_weight_avg_kg,
         stddev_samp(l_discount * 100) AS stddev_road_gradient,
         25 + avg(l_tax * 100) AS fuel_cons_driving_l_per_100km,
         sum(l_quantity) AS mileage_km
  FROM usage GROUP BY ALL),
full_table AS (SELECT * FROM subpop JOIN stats USING (vin, sales_group))"""
_SUBPOP_COLUMNS = """vin, sales_group, cluster_wasserstein_velocity, cluster_velocity_text,
 cluster_wasserstein_weight, cluster_weight_text, cluster_wasserstein_gradient, cluster_gradient_text"""


def cells(groups: str, metrics: str) -> str:
    """KPI cross-table over the 12 cells of the given sales groups."""
    return f"""cells AS (
  SELECT sales_group, velocity, gradient, weight FROM ({groups}) s
  CROSS JOIN (VALUES ('High'), ('Medium'), ('Low')) a(velocity)
  CROSS JOIN (VALUES ('Hilly'), ('Flat')) b(gradient)
  CROSS JOIN (VALUES ('High'), ('Low')) e(weight)),
kpi AS (
  SELECT x.sales_group, velocity, gradient, weight, count(f.vin) AS n_vehicles, {metrics}
  FROM cells x LEFT JOIN full_table f
    ON f.sales_group = x.sales_group AND f.cluster_velocity_text = velocity
   AND f.cluster_gradient_text = gradient AND f.cluster_weight_text = weight
  GROUP BY 1, 2, 3, 4)"""


KPI_METRICS = """round(avg(vehicle_speed_avg_driving_kmh), 4) AS avg_speed,
 round(avg(gc_weight_avg_kg), 4) AS avg_weight,
 round(avg(stddev_road_gradient), 4) AS avg_gradient_std,
 round(avg(fuel_cons_driving_l_per_100km), 4) AS avg_fuel"""

# Cleaning and checks

ORACLES["stage_counts"] = f"""{head(clean("velocity"))}
SELECT 'raw' AS stage, count(DISTINCT vin) AS n_vehicles FROM raw_velocity
UNION ALL SELECT 'outliers', count(DISTINCT vin) FROM outliers
UNION ALL SELECT 'cleaned', count(DISTINCT vin) FROM clean_velocity"""

ORACLES["fleet_audit"] = f"""{head(clean("weight"))},
v AS (SELECT vin, vin IN (SELECT vin FROM outliers) AS listed, sum(count) AS total,
        coalesce(sum(count) FILTER (WHERE lo BETWEEN 12000 AND 49000), 0) AS kept FROM raw_weight GROUP BY 1)
SELECT count(*) AS n_raw, (SELECT count(DISTINCT vin) FROM outliers) AS n_outliers,
  count(*) FILTER (WHERE NOT listed) AS n_cleaned,
  count(*) FILTER (WHERE NOT listed AND kept = 0) AS n_zero_mass, 0::BIGINT AS n_group_conflicts,
  sum(total) FILTER (WHERE NOT listed) AS total, sum(kept) FILTER (WHERE NOT listed) AS kept,
  round(1 - sum(kept) FILTER (WHERE NOT listed) / sum(total) FILTER (WHERE NOT listed), 6) AS dropped_share
FROM v"""

ORACLES["outlier_anti_join"] = f"""{head(clean("velocity"))}
SELECT vin, sales_group, '[' || lo || ', ' || (lo + 1) || ')' AS x1_interval, count FROM clean_velocity"""

ORACLES["sales_group_unique_check"] = """
SELECT 'S' || lpad(cast(l_suppkey AS varchar), 8, '0') AS vin,
       count(DISTINCT o_custkey % 15 + 1) AS n_groups
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey % 15 + 1) > 1"""

ORACLES["zero_mass_vehicles"] = """
SELECT 'O' || lpad(cast(l_orderkey AS varchar), 8, '0') AS vin, cast(count(*) AS double) AS total
FROM lineitem GROUP BY l_orderkey
HAVING count(*) FILTER (WHERE floor(l_extendedprice / 1000) BETWEEN 12 AND 49) = 0"""

ORACLES["dropped_mass"] = f"""{head()}
SELECT signal, total, kept, round((total - kept) / total, 6) AS dropped_share FROM (
  SELECT 'weight' AS signal, cast(count(*) AS double) AS total,
         cast(count(*) FILTER (WHERE w_lo BETWEEN 12000 AND 49000) AS double) AS kept FROM usage
  UNION ALL SELECT 'gradient', cast(count(*) AS double),
         cast(count(*) FILTER (WHERE g_lo BETWEEN 0 AND 9) AS double) FROM usage)"""

# Grids and distributions

ORACLES["interval_centers"] = f"""{head(clean("weight"))},
t AS (SELECT vin, sales_group, '[' || lo || ', ' || (lo + 1000) || ')' AS x1_interval, count FROM raw_weight)
SELECT *, (cast(regexp_extract(x1_interval, '([0-9.]+),', 1) AS double)
         + cast(regexp_extract(x1_interval, ', ([0-9.]+)', 1) AS double)) / 2 AS bin_center FROM t"""

ORACLES["center_bounds_by_signal"] = f"""{head(clean("velocity"), clean("weight"), clean("gradient"))}
SELECT 'velocity' AS signal, min(lo) + 0.5::double AS min_center, max(lo) + 0.5::double AS max_center FROM clean_velocity
UNION ALL SELECT 'weight', min(lo) + 500::double, max(lo) + 500::double FROM clean_weight
UNION ALL SELECT 'gradient', min(lo) + 0.5::double, max(lo) + 0.5::double FROM clean_gradient"""

for _s in ("velocity", "weight", "gradient"):
    ORACLES[f"grid_{_s}"] = f"""{head(dense(_s))}
SELECT bin, center AS bin_center, cast(sum(m) AS double) AS mass FROM d_{_s} GROUP BY 1, 2"""

ORACLES["spectra_probs_long"] = f"""{head(dense("velocity"))}
SELECT vin, center AS bin_center, round(p, 6) AS p FROM d_velocity"""

ORACLES["spectra_cdf_long"] = f"""{head(dense("weight"))}
SELECT vin, center AS bin_center, round(cdf, 6) AS cdf FROM d_weight"""

ORACLES["spectra_running_share"] = f"""{head(dense("gradient"))}
SELECT vin, bin, round(p, 6) AS p, round(cdf, 6) AS cdf,
  cast(coalesce(lead(bin) OVER (PARTITION BY vin ORDER BY bin) - bin, 1) AS double) AS gap
FROM d_gradient WHERE m > 0"""

ORACLES["spectra_pivot_wide"] = f"""{head(dense("gradient"))}
SELECT vin, {", ".join(f"sum(CASE WHEN bin = {i} THEN m ELSE 0 END) AS b{i}" for i in range(10))}
FROM d_gradient GROUP BY vin"""

# Distances

_STATED = f"""{head(points("weight"), MATRIX)},
r AS (SELECT i, j, d * 1000 AS d FROM dm WHERE cast(substr(i, 2) AS bigint) % 20 = 0)"""
ORACLES["w1_pairs"] = f"{_STATED} SELECT i AS vin_i, j AS vin_j, round(d, 4) AS distance FROM r"
ORACLES["w1_nearest"] = f"""{_STATED},
o AS (SELECT i, j, d, cast(row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS int) AS rank FROM r WHERE i <> j)
SELECT i AS vin_i, rank, j AS vin_j, round(d, 4) AS distance FROM o WHERE rank <= 5"""
ORACLES["w1_diagnostics"] = f"""{_STATED}
SELECT (SELECT count(*) FROM r a JOIN r b ON a.i = b.j AND a.j = b.i WHERE abs(a.d - b.d) > 1e-6) AS n_asymmetric,
  count(*) FILTER (WHERE i = j) AS n_stated, count(*) AS n_rows,
  round(max(d) FILTER (WHERE i = j), 4) AS max_diagonal,
  round(min(d) FILTER (WHERE i <> j), 4) AS min_distance,
  round(max(d) FILTER (WHERE i <> j), 4) AS max_distance,
  count(*) FILTER (WHERE d < 0) AS n_negative FROM r"""

ORACLES["nearest_all"] = f"""{head(points("weight"), MATRIX)},
o AS (SELECT i, j, d, cast(row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS int) AS rank FROM dm WHERE i <> j)
SELECT i AS vin, rank, j AS neighbour, round(round(d, 9) * 1000, 4) AS distance FROM o WHERE rank <= 5"""
ORACLES["w1_pairs_sparse"] = f"""{head()},
m AS (SELECT vin, cast(round(l_extendedprice * 100) AS bigint) AS x, count(*) AS n FROM usage
      WHERE vin NOT IN (SELECT vin FROM outliers) GROUP BY ALL),
p AS MATERIALIZED (SELECT vin, x, n / sum(n) OVER (PARTITION BY vin) AS p FROM m),
v AS (SELECT DISTINCT vin FROM p),
e AS (SELECT a.vin AS i, v.vin AS j, a.x, a.p FROM p a CROSS JOIN v WHERE cast(substr(a.vin, 2) AS bigint) % 20 = 0
      UNION ALL SELECT s.vin, b.vin, b.x, -b.p FROM p b CROSS JOIN v s WHERE cast(substr(s.vin, 2) AS bigint) % 20 = 0),
g AS (SELECT i, j, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS f, lead(x) OVER w - x AS gap
      FROM e WINDOW w AS (PARTITION BY i, j ORDER BY x))
SELECT i AS vin_i, j AS vin_j, round(sum(abs(f) * coalesce(gap, 0)) + 1e-7, 2) AS distance FROM g GROUP BY 1, 2"""

ORACLES["w1_leading_matrix"] = f"""{head(points("weight"), MATRIX)},
top AS (SELECT DISTINCT v FROM c ORDER BY v LIMIT 5)
SELECT i AS vin_i, j AS vin_j, round(d * 1000, 4) AS distance FROM dm
WHERE i IN (SELECT v FROM top) AND j IN (SELECT v FROM top)"""

ORACLES["w1_to_reference"] = f"""{head(dense("weight"))},
r AS (SELECT bin, 'mean' AS ref, avg(cdf) AS y FROM d_weight GROUP BY bin
      UNION ALL SELECT DISTINCT bin, 'even', (bin + 1) / 38.0::double FROM d_weight)
SELECT vin, ref, round(1000 * sum(abs(cdf - y)), 4) AS distance FROM d_weight JOIN r USING (bin) GROUP BY 1, 2"""

ORACLES["w1_from_probabilities"] = f"""{head(dense("gradient"))}
SELECT vin, round(sum(abs(cdf - (bin + 1) / 10.0::double)), 6) AS distance FROM d_gradient GROUP BY 1"""

ORACLES["fleet_total_distance"] = f"""{head(points("weight"), MATRIX)}
SELECT i AS vin, round(1000 * sum(d), 2) AS total FROM dm GROUP BY 1"""

ORACLES["fleet_total_distance_sliced"] = ORACLES["fleet_total_distance"]

ORACLES["central_vehicles"] = f"""{head(points("weight"), MATRIX)}
SELECT i AS vin, round(round(avg(d), 9), 6) AS mean_distance FROM dm GROUP BY 1
ORDER BY round(avg(d), 9), 1 LIMIT 10"""

# Clustering

_GROUP = "SELECT DISTINCT vin, sales_group FROM usage"
ORACLES["kmedoids_k2"] = f"""{head(points("gradient"), MATRIX, rounds(2))}
SELECT j AS vin, sales_group, l AS cluster FROM lab JOIN ({_GROUP}) g ON g.vin = j"""

ORACLES["kmedoids_k3"] = f"""{head(points("weight"), MATRIX, rounds(3))}
SELECT j AS vin, sales_group, l AS cluster FROM lab JOIN ({_GROUP}) g ON g.vin = j"""

ORACLES["kmedoids_dense_k3"] = f"""{head(dense("weight"))},
w AS (SELECT vin, bin + o AS bin, sum(m * (13 - abs(o))) AS m
      FROM d_weight CROSS JOIN (SELECT unnest(range(-12, 13)) AS o) WHERE m > 0 AND bin + o BETWEEN 0 AND 37 GROUP BY ALL),
c AS MATERIALIZED (
  SELECT vin AS v, bin AS b,
    sum(coalesce(m, 0)) OVER (PARTITION BY vin ORDER BY bin) / sum(m) OVER (PARTITION BY vin) AS x
  FROM (SELECT DISTINCT vin FROM w) CROSS JOIN (SELECT unnest(range(38)) AS bin) LEFT JOIN w USING (vin, bin)),
{MATRIX}, {rounds(3)}
SELECT j AS vin, sales_group, l AS cluster FROM lab JOIN ({_GROUP}) g ON g.vin = j"""

ORACLES["kmedoids_labels_velocity"] = f"""{head(points("velocity"), MATRIX, rounds(3))}
SELECT j AS vin, sales_group, l AS cluster_wasserstein FROM lab JOIN ({_GROUP}) g ON g.vin = j"""

ORACLES["kmedoids_velocity_stray"] = f"""{head(clean("velocity"))},
far AS (SELECT vin, lo, count FROM clean_velocity
        UNION ALL SELECT min(vin), 1000000000, 1.0 FROM clean_velocity),
axis AS (SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo) - lo, 1) AS w FROM (SELECT DISTINCT lo FROM far)),
c AS MATERIALIZED (
  SELECT v.vin AS v, a.lo AS b, a.w * sum(coalesce(f.count, 0)) OVER (PARTITION BY v.vin ORDER BY a.lo)
    / sum(coalesce(f.count, 0)) OVER (PARTITION BY v.vin) AS x
  FROM (SELECT DISTINCT vin FROM far) v CROSS JOIN axis a LEFT JOIN far f ON f.vin = v.vin AND f.lo = a.lo),
{MATRIX}, {rounds(3)}
SELECT j AS vin, sales_group, l AS cluster_wasserstein FROM lab JOIN ({_GROUP}) g ON g.vin = j"""

ORACLES["medoid_profile"] = f"""{head(points("weight"), MATRIX, rounds(3))}
SELECT l AS cluster, vin, bin, center AS bin_center, round(p, 6) AS p FROM m_16 JOIN d_weight ON vin = i"""

_SIL3 = head(points("weight"), MATRIX, rounds(3), silhouettes())
ORACLES["silhouette_k3"] = f"{_SIL3} SELECT round(avg(s), 6) AS silhouette FROM sil"
ORACLES["silhouette_by_cluster"] = f"""{_SIL3}
SELECT l AS cluster, count(*) AS n_vehicles, round(avg(s), 6) AS silhouette FROM sil GROUP BY 1"""
ORACLES["silhouette_by_vehicle"] = f"""{_SIL3}
SELECT i AS vin, l AS cluster, round(s, 6) AS silhouette FROM sil"""

_KS = range(2, 7)
_SWEEP = head(
    points("weight"), MATRIX, *[f"{rounds(k, 14, k)},\n{silhouettes(k)}" for k in _KS]
) + ",\nscores AS (" + " UNION ALL ".join(
    f"SELECT cast({k} AS int) AS k, avg(s) AS silhouette FROM sil{k}" for k in _KS
) + ")"
ORACLES["k_sweep"] = f"{_SWEEP} SELECT k, round(silhouette, 6) AS silhouette FROM scores"
ORACLES["best_k"] = f"""{_SWEEP}
SELECT k, round(silhouette, 6) AS silhouette FROM scores ORDER BY round(silhouette, 9) DESC, k LIMIT 1"""

ORACLES["soft_membership"] = f"""{head(points("gradient"), MATRIX, rounds(2))},
raw AS (SELECT dm.j, m.l, round(dm.d, 9) AS d,
               count(*) FILTER (WHERE round(dm.d, 9) <= 0) OVER (PARTITION BY dm.j) AS hits
        FROM m_16 m JOIN dm ON dm.i = m.i),
w AS (SELECT j, l, CASE WHEN hits > 0 THEN CASE WHEN d <= 0 THEN 1.0::double ELSE 0 END ELSE 1 / d END AS w FROM raw)
SELECT j AS vin, l AS cluster, round(w / sum(w) OVER (PARTITION BY j), 6) AS weight FROM w"""

ORACLES["multi_signal_k2"] = f"""{head(dense("weight"), dense("gradient"))},
c AS MATERIALIZED (
  SELECT vin AS v, bin AS b, cdf AS x FROM d_weight WHERE vin IN (SELECT vin FROM d_gradient)
  UNION ALL SELECT vin, 100 + bin, 2 * cdf FROM d_gradient WHERE vin IN (SELECT vin FROM d_weight)),
{MATRIX}, {rounds(2)}
SELECT j AS vin, sales_group, l AS cluster FROM lab JOIN ({_GROUP}) g ON g.vin = j"""

# Reports on clusters

ORACLES["cluster_sizes"] = f"""{head(clustered("velocity"))}
SELECT cluster AS cluster_wasserstein, count(*) AS n_vehicles FROM s_velocity GROUP BY 1"""

ORACLES["cluster_sales_group_crosstab"] = f"""{head(clustered("velocity"))}
SELECT cluster AS cluster_wasserstein,
 {", ".join(f"count(*) FILTER (WHERE sales_group = {g}) AS sg_{g}" for g in range(1, 16))}
FROM s_velocity GROUP BY 1"""


def _shares(signal: str, codes: int, digits: int, where: str = "") -> str:
    return f"""{head(clustered(signal))},
n AS (SELECT g.sales_group, k.cluster, count(s.vin) AS n_vehicles
      FROM (SELECT DISTINCT sales_group FROM s_{signal} {where}) g
      CROSS JOIN (SELECT cast(unnest(range({codes})) AS int) AS cluster) k
      LEFT JOIN s_{signal} s ON s.sales_group = g.sales_group AND s.cluster = k.cluster GROUP BY 1, 2),
q AS (SELECT *, round(100.0::double * n_vehicles / sum(n_vehicles) OVER (PARTITION BY sales_group), {digits}) AS percent FROM n)
SELECT sales_group, cluster, n_vehicles, percent, printf('%.{digits}f', percent) || '%' AS percent_text"""


ORACLES["cluster_share_all"] = _shares("velocity", 3, 1) + " FROM q"
ORACLES["cluster_share_selected"] = (
    _shares("weight", 2, 0, "WHERE sales_group IN (5, 8, 1)")
    + """, cast(list_position([5, 8, 1], sales_group) AS int) AS position FROM q
ORDER BY position, cluster"""
)

ORACLES["sales_groups_sorted"] = f"""{head(clustered("velocity"))}
SELECT DISTINCT sales_group FROM s_velocity ORDER BY 1"""

ORACLES["cluster_profile_mean"] = f"""{head(clustered("weight"))}
SELECT cluster, bin, center AS bin_center, round(avg(p), 6) AS mean_p
FROM d_weight JOIN s_weight USING (vin) GROUP BY 1, 2, 3"""


def _density(signal: str) -> str:
    return f"""{head(clustered(signal))},
e AS (SELECT cluster, bin, center, sum(m) AS m FROM d_{signal} JOIN s_{signal} USING (vin)
      GROUP BY 1, 2, 3 HAVING sum(m) > 0),
y AS (SELECT cluster, bin, center, m / sum(m) OVER (PARTITION BY cluster) / {_WIDTH[signal]} AS density,
             sum(m) OVER (PARTITION BY cluster ORDER BY bin) / sum(m) OVER (PARTITION BY cluster) AS cumulative FROM e)"""


ORACLES["cluster_density"] = f"""{_density("weight")}
SELECT cluster, bin, center AS bin_center, round(density * 1000, 6) AS density_per_thousand,
       round(cumulative, 6) AS cumulative FROM y"""
ORACLES["density_quantiles"] = f"""{_density("gradient")}
SELECT cluster, min(center) FILTER (WHERE cumulative >= 0.25 - 1e-12) AS q25,
       min(center) FILTER (WHERE cumulative >= 0.5 - 1e-12) AS q50,
       min(center) FILTER (WHERE cumulative >= 0.75 - 1e-12) AS q75 FROM y GROUP BY 1"""

ORACLES["auto_labels"] = f"""{head(clustered("velocity"))},
r AS (SELECT cluster, avg(mean_center) AS mean_center FROM s_velocity GROUP BY 1),
o AS (SELECT *, cast(row_number() OVER (ORDER BY mean_center) - 1 AS int) AS rank FROM r)
SELECT cluster, round(mean_center, 6) AS mean_center, rank,
       CASE rank WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS label FROM o"""

ORACLES["auto_labels_k4"] = f"""{head(clustered("gradient", 4))},
r AS (SELECT cluster, avg(mean_center) AS mean_center FROM s_gradient GROUP BY 1),
o AS (SELECT *, cast(row_number() OVER (ORDER BY round(mean_center, 9), cluster) - 1 AS int) AS rank FROM r)
SELECT cluster, round(mean_center, 6) AS mean_center, rank,
       CASE WHEN rank < 2 THEN 'Flat' ELSE 'Hilly' END AS label FROM o"""

ORACLES["weight_labels_of_best_k"] = f"""{_SWEEP},
best AS (SELECT k FROM scores ORDER BY round(silhouette, 9) DESC, k LIMIT 1),
labs AS ({" UNION ALL ".join(f"SELECT {k} AS k, j, l FROM lab{k}" for k in _KS)}),
pick AS (SELECT j, l FROM labs WHERE k = (SELECT k FROM best)),
means AS (SELECT l, avg(mc) AS m FROM pick JOIN
  (SELECT vin, sum(p * center) AS mc FROM d_weight GROUP BY 1) ON vin = j GROUP BY 1),
named AS (SELECT l, CASE WHEN floor((row_number() OVER (ORDER BY round(m, 9), l) - 1)
  / cast((SELECT count(*) FROM means) - 1 AS double) + 0.5) < 1 THEN 'Low' ELSE 'High' END AS text FROM means)
SELECT j AS vin, sales_group, l AS cluster_wasserstein_weight, text AS cluster_weight_text
FROM pick JOIN named USING (l) JOIN ({_GROUP}) g ON g.vin = j"""



def pca(signal: str, squarings: int = 14) -> str:
    """``pc``: vin, pc1, pc2; ``share``: of each. Eigenvectors by repeated squaring, the second one from
    the deflated covariance; the largest loading is positive."""
    parts = [
        f"""mu AS (SELECT bin, avg(p) AS m FROM d_{signal} GROUP BY bin),
y AS MATERIALIZED (SELECT vin, bin, p - mu.m AS y FROM d_{signal} JOIN mu USING (bin)),
cov1 AS MATERIALIZED (SELECT a.bin AS i, b.bin AS j, sum(a.y * b.y) AS v FROM y a JOIN y b USING (vin) GROUP BY 1, 2)"""
    ]
    for n in (1, 2):
        parts.append(
            f"q{n}_0 AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM cov{n})"
        )
        for t in range(1, squarings + 1):
            parts.append(
                f"""q{n}_{t} AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM (
  SELECT a.i, b.j, sum(a.v * b.v) AS v FROM q{n}_{t - 1} a JOIN q{n}_{t - 1} b ON a.j = b.i GROUP BY 1, 2))"""
            )
        last = f"q{n}_{squarings}"
        parts.append(
            f"""e{n} AS MATERIALIZED (
  SELECT i, v / sqrt(sum(v * v) OVER ()) * CASE WHEN abs(max(v) OVER ()) >= abs(min(v) OVER ()) THEN 1 ELSE -1 END AS v
  FROM {last} WHERE j = (SELECT j FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1)),
l{n} AS MATERIALIZED (SELECT sum(a.v * c.v * b.v) AS l FROM e{n} a JOIN cov{n} c ON a.i = c.i JOIN e{n} b ON b.i = c.j),
cov{n + 1} AS MATERIALIZED (
  SELECT c.i, c.j, c.v - (SELECT l FROM l{n}) * a.v * b.v AS v
  FROM cov{n} c JOIN e{n} a ON a.i = c.i JOIN e{n} b ON b.i = c.j)"""
        )
    parts.append(
        """pc AS (SELECT vin, sum(y * e1.v) AS pc1, sum(y * e2.v) AS pc2
  FROM y JOIN e1 ON e1.i = bin JOIN e2 ON e2.i = bin GROUP BY 1),
trace AS (SELECT sum(v) AS s FROM cov1 WHERE i = j)"""
    )
    return ",\n".join(parts)


ORACLES["pca_2d"] = f"""{head(dense("velocity"), pca("velocity"))}
SELECT vin, round(pc1, 4) + 0.0 AS pc1, round(pc2, 4) + 0.0 AS pc2,
  round((SELECT l FROM l1) / (SELECT s FROM trace), 5) AS pc1_share,
  round((SELECT l FROM l2) / (SELECT s FROM trace), 5) AS pc2_share FROM pc"""
ORACLES["pca_by_k"] = f"""{head(points("gradient"), MATRIX, *[rounds(k, 16, k) for k in _KS], pca("gradient"))},
labs AS ({" UNION ALL ".join(f"SELECT cast({k} AS int) AS k, j, l FROM lab{k}" for k in _KS)})
SELECT k, vin, round(pc1, 4) + 0.0 AS pc1, round(pc2, 4) + 0.0 AS pc2, l AS cluster FROM pc JOIN labs ON j = vin"""

# Sub-populations

ORACLES["label_map"] = f"""{head(ALL_CLUSTERS)},
u AS (SELECT 'velocity' AS signal, cluster FROM s_velocity
      UNION ALL SELECT 'weight', cluster FROM s_weight UNION ALL SELECT 'gradient', cluster FROM s_gradient)
SELECT u.signal, u.cluster, label, display_label, count(*) AS n_vehicles FROM u JOIN (VALUES
 ('velocity', 0, 'Medium', 'Medium'), ('velocity', 1, 'High', 'High'), ('velocity', 2, 'Low', 'Low'),
 ('weight', 0, 'High', 'High Weight'), ('weight', 1, 'Low', 'Low Weight'),
 ('gradient', 0, 'Hilly', 'Hilly Road'), ('gradient', 1, 'Flat', 'Flat Road')
) l(signal, cluster, label, display_label) ON l.signal = u.signal AND l.cluster = u.cluster GROUP BY ALL"""

ORACLES["unmapped_codes"] = f"""{head(clustered("velocity"))}
SELECT cluster, count(*) AS n_vehicles FROM s_velocity WHERE cluster NOT IN (0, 1) GROUP BY 1"""

ORACLES["stats_union"] = f"""{head(SUBPOP)}
SELECT vin, sales_group, mileage_km, round(vehicle_speed_avg_driving_kmh, 4) AS vehicle_speed_avg_driving_kmh,
 round(gc_weight_avg_kg, 4) AS gc_weight_avg_kg, round(stddev_road_gradient, 4) AS stddev_road_gradient,
 round(fuel_cons_driving_l_per_100km, 4) AS fuel_cons_driving_l_per_100km FROM stats"""

ORACLES["stats_of_one_group"] = f"""{head(SUBPOP)}
SELECT vin, sales_group, mileage_km FROM stats WHERE sales_group = 7"""

ORACLES["subpopulation_join"] = f"{head(SUBPOP)} SELECT {_SUBPOP_COLUMNS} FROM subpop"
ORACLES["subpopulation_saved"] = (
    f"{head(SUBPOP)} SELECT {_SUBPOP_COLUMNS} FROM subpop WHERE sales_group = 3"
)
ORACLES["subpopulation_preview"] = (
    f"{head(SUBPOP)} SELECT {_SUBPOP_COLUMNS} FROM subpop ORDER BY vin LIMIT 10"
)
ORACLES["vehicles_per_sales_group"] = f"""{head(SUBPOP)}
SELECT sales_group, count(vin) AS num_vins FROM subpop GROUP BY 1"""
ORACLES["subpopulation_stats"] = f"""{head(SUBPOP)}
SELECT {_SUBPOP_COLUMNS}, round(vehicle_speed_avg_driving_kmh, 4) AS vehicle_speed_avg_driving_kmh,
 round(gc_weight_avg_kg, 4) AS gc_weight_avg_kg, round(stddev_road_gradient, 4) AS stddev_road_gradient,
 round(fuel_cons_driving_l_per_100km, 4) AS fuel_cons_driving_l_per_100km, mileage_km FROM full_table"""

_ONE = cells("SELECT 1 AS sales_group", KPI_METRICS)
_EVERY = cells(
    "SELECT DISTINCT sales_group FROM full_table",
    f"{KPI_METRICS}, round(avg(mileage_km), 4) AS avg_mileage",
)
ORACLES["kpi_crosstab_one_group"] = f"{head(SUBPOP, _ONE)} SELECT * FROM kpi"
ORACLES["kpi_crosstab_all_groups"] = f"{head(SUBPOP, _EVERY)} SELECT * FROM kpi"
ORACLES["kpi_matrix_vehicles"] = f"{head(SUBPOP, _EVERY)} " + " UNION ALL ".join(
    f"""SELECT sales_group, velocity, '{m}' AS metric, {", ".join(
    f"round(cast(max({m}) FILTER (WHERE gradient = '{g}' AND weight = '{w}') AS double), 4) AS {g}_{w}"
    for g in ("Hilly", "Flat") for w in ("High", "Low"))}
FROM kpi GROUP BY 1, 2"""
    for m in ("n_vehicles", "avg_speed", "avg_weight", "avg_gradient_std", "avg_fuel")
)
_TEXTS = {
    "avg_speed": "vehicle_speed_avg_driving_kmh",
    "avg_weight": "gc_weight_avg_kg",
    "avg_gradient_std": "stddev_road_gradient",
    "avg_fuel": "fuel_cons_driving_l_per_100km",
}
ORACLES["kpi_display"] = f"""{head(SUBPOP, cells("SELECT 1 AS sales_group",
    ", ".join(f"avg({c}) AS {a}" for a, c in _TEXTS.items())))}
SELECT sales_group, velocity, gradient || ' Road' || chr(10) || weight || ' Weight' AS cell,
 {", ".join(f"printf('%.1f', round({a}, 1)) AS {a}_text, {a} IS NULL AS {a}_masked" for a in _TEXTS)} FROM kpi"""

ORACLES["config_fit"] = f"""{head(SUBPOP)},
f AS (SELECT sales_group, sales_group % 3 AS e,
       (cluster_weight_text = 'High')::int + (cluster_gradient_text = 'Hilly')::int AS d FROM subpop)
SELECT sales_group, count(*) AS n_vehicles,
 round(100.0::double * count(*) FILTER (WHERE e > d) / count(*), 1) AS over_percent,
 round(100.0::double * count(*) FILTER (WHERE e < d) / count(*), 1) AS under_percent,
 round(100.0::double * count(*) FILTER (WHERE e = d) / count(*), 1) AS match_percent FROM f GROUP BY 1"""

# Exploring the fleet

ORACLES["rebin"] = f"""{head(dense("weight"))}
SELECT vin, sales_group,
  '[' || (12000 + bin // 4 * 4000) || ', ' || (16000 + bin // 4 * 4000) || ')' AS x1_interval,
  cast(sum(m) AS double) AS count
FROM d_weight WHERE m > 0 GROUP BY 1, 2, 3"""

ORACLES["fleet_sample"] = f"""{head(clean("velocity"))}
SELECT vin, sales_group, '[' || lo || ', ' || (lo + 1) || ')' AS x1_interval, count FROM clean_velocity
WHERE ('0x' || substr(md5(vin), 1, 8))::bigint % 4 < 1"""

ORACLES["region_filter"] = f"""{head(clean("velocity"))}
SELECT vin, sum(count) AS total FROM clean_velocity WHERE vin IN (
  SELECT 'V' || lpad(cast(c_custkey AS varchar), 8, '0') FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'EUROPE' AND c_mktsegment = 'BUILDING') GROUP BY 1"""

_SPECTRUM = """b AS (SELECT 'V' || lpad(cast(user_id AS varchar), 8, '0') AS vin,
 cast(user_id % 15 + 1 AS int) AS sales_group, cast(floor(value / 10) AS bigint) AS bin,
 cast(count(*) AS double) AS count FROM events GROUP BY 1, 2, 3)"""
for _s in ("spectrum_build", "spectrum_build_stream"):
    ORACLES[_s] = f"""WITH {_SPECTRUM}
SELECT vin, sales_group, '[' || bin * 10 || ', ' || (bin * 10 + 10) || ')' AS x1_interval, count FROM b"""
ORACLES["spectrum_distributions"] = f"""WITH {_SPECTRUM},
g AS (SELECT unnest(range((SELECT max(bin) + 1 FROM b))) AS bin),
t AS (SELECT vin, sum(count) AS total FROM b WHERE bin >= 0 GROUP BY 1)
SELECT vin, cast(bin AS int) AS bin, round(coalesce(count, 0) / total, 6) AS p,
 round(sum(coalesce(count, 0)) OVER (PARTITION BY vin ORDER BY bin) / total, 6) AS cdf
FROM t CROSS JOIN g LEFT JOIN b USING (vin, bin)"""

ORACLES["subpopulation_bucketed"] = ORACLES["subpopulation_stats"]
