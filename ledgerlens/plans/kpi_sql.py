"""SQL text generators for the oracle side of the KPI, series and anomaly queries.

`keys` are quoted column names of the source CTE; an empty key list uses a constant
segment column so one template covers the whole-table and the per-segment case.
"""

from __future__ import annotations


def _q(c: str) -> str:
    return f'"{c}"'


def kpi_ctes(src: str, keys: list[str], has_profit: bool = False) -> tuple[str, list[str]]:
    """CTEs ending in `kpi` with one row per segment (all 21 fields + keys)."""
    k = [_q(c) for c in keys] or ['"seg"']
    kl = ", ".join(k)
    seg_col = "" if keys else ', 1 AS "seg"'
    using = ", ".join(k)

    def top_weak(col: str, label: str) -> str:
        return f"""
{label}_g AS (SELECT {kl}, "{col}" AS name, sum(rev) AS rev FROM base GROUP BY {kl}, "{col}"),
{label}_r AS (SELECT *, row_number() OVER (PARTITION BY {kl} ORDER BY rev DESC, name) AS rt,
                 row_number() OVER (PARTITION BY {kl} ORDER BY rev, name) AS rw FROM {label}_g),
{label}_a AS (SELECT {kl}, count(*) AS unique_{label}s,
                 max(CASE WHEN rt = 1 THEN name END) AS top_{label},
                 max(CASE WHEN rt = 1 THEN rev END) AS top_{label}_revenue,
                 max(CASE WHEN rw = 1 THEN name END) AS weak_{label},
                 max(CASE WHEN rw = 1 THEN rev END) AS weak_{label}_revenue
              FROM {label}_r GROUP BY {kl}),"""

    profit_sum = 'sum(TRY_CAST("Profit" AS DOUBLE))' if has_profit else "CAST(NULL AS DOUBLE)"
    profit = "COALESCE(t.profit_sum, 0.0)" if has_profit else "t.total_revenue * 0.35"
    ctes = f"""base AS (SELECT *{seg_col}, CAST("Revenue" AS DOUBLE) AS rev FROM {src}),
tot AS (SELECT {kl}, sum(rev) AS total_revenue, avg(rev) AS avg_revenue, count(*) AS total_records,
          stddev_samp(rev) AS std_rev, min("Date") AS first_ds, max("Date") AS last_ds,
          {profit_sum} AS profit_sum
        FROM base GROUP BY {kl}),{top_weak("Product", "product")}{top_weak("Region", "region")}
days AS (SELECT {kl}, "Date" AS ds, sum(rev) AS y FROM base GROUP BY {kl}, "Date"),
g0 AS (SELECT d.*, datediff('day', t.first_ds, t.last_ds) + 1 AS n,
              datediff('day', t.first_ds, d.ds) AS pos
       FROM days d JOIN tot t USING ({using})),
g1 AS (SELECT {kl}, max(n) AS n_days,
         sum(CASE WHEN pos >= n - 30 THEN y ELSE 0 END) AS s_last,
         sum(CASE WHEN pos >= n - 60 AND pos < n - 30 THEN y ELSE 0 END) AS s_prev,
         sum(CASE WHEN pos >= n // 2 THEN y ELSE 0 END) AS s_second,
         sum(CASE WHEN pos < n // 2 THEN y ELSE 0 END) AS s_first,
         sum(y) AS s_all
       FROM g0 GROUP BY {kl}),
g2 AS (SELECT {kl}, n_days,
         CASE WHEN n_days >= 60 THEN s_last / 30 WHEN n_days >= 10 THEN s_second / (n_days - n_days // 2)
              ELSE s_all / n_days END AS recent,
         CASE WHEN n_days >= 60 THEN s_prev / 30 WHEN n_days >= 10 THEN s_first / (n_days // 2)
              ELSE s_all / n_days END AS previous
       FROM g1),
growth AS (SELECT {kl}, n_days, recent, previous,
         CASE WHEN previous > 0 THEN (recent - previous) / previous * 100
              WHEN recent > 0 THEN 100.0 ELSE 0.0 END AS growth_pct FROM g2),
kpi AS (
  SELECT {", ".join("t." + c for c in k)}, t.total_revenue, t.avg_revenue, t.total_records,
         {profit} AS profit,
         CASE WHEN t.total_revenue > 0 THEN {profit} / t.total_revenue * 100 ELSE 0.0 END AS margin_pct,
         COALESCE(p.unique_products, 0) AS unique_products,
         COALESCE(r.unique_regions, 0) AS unique_regions,
         COALESCE(g.growth_pct, 0.0) AS growth_pct,
         CASE WHEN t.avg_revenue > 0 THEN t.std_rev / t.avg_revenue * 100 ELSE 0.0 END AS volatility_pct,
         p.top_product, p.top_product_revenue,
         CASE WHEN t.total_revenue > 0 THEN p.top_product_revenue / t.total_revenue * 100 ELSE 0.0 END AS top_product_share,
         p.weak_product, p.weak_product_revenue,
         CASE WHEN t.total_revenue > 0 THEN p.weak_product_revenue / t.total_revenue * 100 ELSE 0.0 END AS weak_product_share,
         r.top_region, r.top_region_revenue,
         CASE WHEN t.total_revenue > 0 THEN r.top_region_revenue / t.total_revenue * 100 ELSE 0.0 END AS top_region_share,
         r.weak_region, r.weak_region_revenue,
         CASE WHEN t.total_revenue > 0 THEN r.weak_region_revenue / t.total_revenue * 100 ELSE 0.0 END AS weak_region_share,
         CAST(g.n_days AS INTEGER) AS n_days
  FROM tot t LEFT JOIN product_a p USING ({using}) LEFT JOIN region_a r USING ({using})
       LEFT JOIN growth g USING ({using})
)"""
    return ctes, k

