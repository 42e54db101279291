"""DuckDB SQL for the queries, written against the supplied tables on its own.

``CTES`` are named building blocks; ``sql`` puts the ones a text mentions in front of it.
"""

from __future__ import annotations

import re

from prodlake.harness.queries import B_GRID, DECIMALS, DI_GRID, ETHANE_THRESHOLD, OPERATOR, PLAY, TOP_WELLS, WELL

CTES = {
    "wells_of": """
        SELECT s_suppkey, s_name, s_acctbal, n_name, r_name, r_regionkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "production": """
        SELECT CAST(l_suppkey AS VARCHAR) AS api_number, s_name AS well_name, n_name AS operator,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS production_month,
               CAST(year(l_shipdate) AS INTEGER) AS production_year,
               'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS production_quarter,
               CASE l_linestatus WHEN 'O' THEN 'O' ELSE 'G' END AS oil_and_gas_group,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS production,
               r_name AS shale_play, r_name AS basin, s_acctbal AS well_length_ft
        FROM lineitem JOIN wells_of ON l_suppkey = s_suppkey
        GROUP BY ALL""",
    "flaring": """
        SELECT n_name AS operator,
               round(CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT'
                                   THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) * 0.1, 2)
                 AS total_flared_gas_mcf
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name
        UNION ALL
        SELECT r_name, CAST(1000.0 * (r_regionkey + 1) AS DOUBLE) FROM region""",
    # --- KPI tables
    "oil": """
        SELECT operator, SUM(production) AS total_oil_bbl, COUNT(DISTINCT api_number) AS well_count,
               AVG(production) AS avg_monthly_production
        FROM production WHERE oil_and_gas_group = 'O' GROUP BY operator""",
    "gas": """
        SELECT operator, SUM(production) AS total_gas_mcf
        FROM production WHERE oil_and_gas_group = 'G' GROUP BY operator""",
    "perf": """
        SELECT operator, total_oil_bbl, well_count, avg_monthly_production, total_gas_mcf,
               total_flared_gas_mcf AS total_flaring_mcf,
               CASE WHEN total_gas_mcf > 0 THEN total_flared_gas_mcf / total_gas_mcf END
                 AS flaring_intensity_ratio,
               CAST(RANK() OVER (ORDER BY total_oil_bbl DESC NULLS LAST) AS INTEGER) AS production_rank
        FROM oil FULL JOIN gas USING (operator) LEFT JOIN flaring USING (operator)""",
    "intensity": """
        SELECT operator, total_flared_gas_mcf, total_gas_mcf AS total_gas_production_mcf,
               CASE WHEN total_gas_mcf > 0 THEN total_flared_gas_mcf / total_gas_mcf * 100 END
                 AS flaring_intensity_ratio,
               CAST(RANK() OVER (ORDER BY CASE WHEN total_gas_mcf > 0
                                THEN total_flared_gas_mcf / total_gas_mcf * 100 END DESC NULLS LAST)
                    AS INTEGER) AS flaring_rank,
               CASE WHEN total_flared_gas_mcf / total_gas_mcf * 100 < 5 THEN 'Low'
                    WHEN total_flared_gas_mcf / total_gas_mcf * 100 BETWEEN 5 AND 15 THEN 'Medium'
                    ELSE 'High' END AS flaring_category
        FROM flaring LEFT JOIN gas USING (operator)""",
    "ethane": f"""
        SELECT operator, production_year, shale_play, liquid_rich_production, dry_gas_production,
               liquid_rich_production / dry_gas_production AS ethane_dry_gas_ratio,
               CASE WHEN liquid_rich_production / dry_gas_production > {ETHANE_THRESHOLD}
                    THEN 'Liquid-Rich' ELSE 'Dry Gas' END AS basin_category
        FROM (SELECT operator, production_year, shale_play,
                     SUM(production) FILTER (WHERE oil_and_gas_group = 'O') AS liquid_rich_production,
                     NULLIF(SUM(production) FILTER (WHERE oil_and_gas_group = 'G'), 0) AS dry_gas_production
              FROM production GROUP BY operator, production_year, shale_play)""",
    "monthly": """
        SELECT shale_play, production_month, oil_and_gas_group, SUM(production) AS total_production
        FROM production GROUP BY shale_play, production_month, oil_and_gas_group""",
    "lagged": """
        SELECT *, LAG(total_production, 1) OVER w AS prev_month, LAG(total_production, 12) OVER w AS prev_year,
               CAST(RANK() OVER (PARTITION BY production_month, oil_and_gas_group
                                 ORDER BY total_production DESC) AS INTEGER) AS rnk
        FROM monthly WINDOW w AS (PARTITION BY shale_play, oil_and_gas_group ORDER BY production_month)""",
    "trends": """
        SELECT shale_play, production_month, oil_and_gas_group, total_production,
               prev_month AS prev_month_production,
               CASE WHEN prev_month > 0 THEN (total_production - prev_month) / prev_month * 100 END AS mom_growth_pct,
               CASE WHEN prev_year > 0 THEN (total_production - prev_year) / prev_year * 100 END AS yoy_growth_pct,
               rnk AS production_rank
        FROM lagged""",
    "peak": """
        SELECT api_number, production_month AS peak_oil_month FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY api_number
                                         ORDER BY production DESC, production_month) AS rn
            FROM production WHERE oil_and_gas_group = 'O') WHERE rn = 1""",
    "lifetime": """
        SELECT api_number, well_name, operator, well_length_ft, shale_play, basin,
               MIN(production_month) AS first_production_month, MAX(production_month) AS last_production_month,
               SUM(production) AS cumulative_oil_bbl, MAX(production) AS peak_oil_production,
               COUNT(*) AS active_months
        FROM production WHERE oil_and_gas_group = 'O'
        GROUP BY api_number, well_name, operator, well_length_ft, shale_play, basin""",
    "well_gas": """
        SELECT api_number, SUM(production) AS cumulative_gas_mcf
        FROM production WHERE oil_and_gas_group = 'G' GROUP BY api_number""",
    "summary": """
        SELECT api_number, well_name, operator, first_production_month, last_production_month,
               cumulative_oil_bbl, cumulative_gas_mcf, peak_oil_month, peak_oil_production,
               well_length_ft, active_months, shale_play, basin
        FROM lifetime LEFT JOIN well_gas USING (api_number) LEFT JOIN peak USING (api_number)""",
    # --- flaring tiers
    "cuts": """
        SELECT quantile_cont(total_flared_gas_mcf, 0.33) AS p33, quantile_cont(total_flared_gas_mcf, 0.67) AS p67
        FROM flaring""",
    "tiered": """
        SELECT operator, total_flared_gas_mcf,
               CASE WHEN total_flared_gas_mcf >= (SELECT p67 FROM cuts) THEN 'High'
                    WHEN total_flared_gas_mcf <= (SELECT p33 FROM cuts) THEN 'Low' ELSE 'Medium' END
                 AS volume_category
        FROM flaring""",
    # --- raw feeds
    "raw_monthly": """
        SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, l_linestatus, l_returnflag AS flag,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount
        FROM lineitem GROUP BY ALL""",
    "raw_production": """
        SELECT CAST(l_suppkey AS VARCHAR) AS api_number,
               CASE WHEN flag <> 'A' THEN s_name END AS well_name,
               CASE WHEN flag = 'R' THEN '  ' || lower(n_name) || ' ' ELSE n_name END AS operator,
               CASE WHEN flag = 'R' AND month(m) = 7 THEN strftime(m, '%Y/%m/%d')
                    ELSE strftime(m, '%Y-%m-%d') END AS production_month,
               CASE l_linestatus WHEN 'O' THEN 'O' ELSE 'G' END AS oil_and_gas_group,
               CASE WHEN flag = 'R' AND amount >= 100000 THEN format('{:,.2f}', CAST(amount AS DOUBLE))
                    WHEN flag = 'N' AND month(m) = 3 THEN '-' || CAST(amount AS VARCHAR)
                    ELSE CAST(amount AS VARCHAR) END AS production,
               r_name AS shale_play, r_name AS basin
        FROM raw_monthly JOIN wells_of ON l_suppkey = s_suppkey""",
    "raw_wells": """
        SELECT CASE WHEN s_acctbal < 0 THEN 'n/a' ELSE CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) END
                 AS squarerootsum, s_name AS well_name,
               CASE WHEN s_acctbal > -800 THEN CAST(s_suppkey AS VARCHAR) END AS api_number
        FROM supplier
        UNION ALL
        SELECT CAST(CAST(s_acctbal AS DECIMAL(18,2)) + 1000 AS VARCHAR), upper(s_name), CAST(s_suppkey AS VARCHAR)
        FROM supplier WHERE s_acctbal >= 5000""",
    "raw_flaring": """
        SELECT CASE WHEN o_orderstatus = 'P' THEN ' ' || lower(n_name) ELSE n_name END AS operator,
               CASE WHEN o_orderstatus = 'F' THEN 'pending'
                    ELSE format('{:,.2f}', CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT'
                                THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)) END
                 AS totalflaredgas_mcf
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name, o_orderstatus
        UNION ALL
        SELECT CASE WHEN r_name <> 'ASIA' THEN r_name END,
               format('{:,.2f}', CAST((r_regionkey + 1) * 1000 AS DOUBLE)) FROM region""",
    "raw_counts": """
        SELECT n_name AS reported_operator, CAST(COUNT(*) AS VARCHAR) AS uniqueoperatorcount
        FROM wells_of GROUP BY n_name""",
    "raw_shale": """
        SELECT shale_play AS shale_plays, strftime(production_month, '%Y-%m') AS "month",
               oil_and_gas_group AS oilandgasgroup,
               CAST(SUM(CAST(production AS DECIMAL(18,2))) AS VARCHAR) AS total_production,
               CASE WHEN oil_and_gas_group = 'O' THEN '1' END AS "rank"
        FROM production GROUP BY shale_play, production_month, oil_and_gas_group""",
    # --- cleaned tables
    "typed_production": """
        SELECT api_number, well_name, trim(upper(operator)) AS operator,
               CAST(try_strptime(production_month, '%Y-%m-%d') AS DATE) AS production_month, oil_and_gas_group,
               TRY_CAST(production AS DOUBLE) AS production, shale_play, basin
        FROM raw_production""",
    "silver_facts": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, ROW_NUMBER() OVER (
                PARTITION BY api_number, production_month, oil_and_gas_group
                ORDER BY well_name NULLS FIRST, operator, production, shale_play, basin) AS rn
            FROM typed_production
            WHERE api_number IS NOT NULL AND production_month IS NOT NULL AND operator IS NOT NULL
              AND production >= 0) WHERE rn = 1""",
    "silver_wells": """
        SELECT api_number, well_name, well_length_ft FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY api_number
                                         ORDER BY well_name NULLS FIRST, well_length_ft NULLS FIRST) AS rn
            FROM (SELECT api_number, well_name, TRY_CAST(squarerootsum AS DOUBLE) AS well_length_ft
                  FROM raw_wells) WHERE api_number IS NOT NULL) WHERE rn = 1""",
    "silver_flaring": """
        SELECT operator, MIN(volume) AS total_flared_gas_mcf
        FROM (SELECT trim(upper(operator)) AS operator,
                     TRY_CAST(replace(totalflaredgas_mcf, ',', '') AS DOUBLE) AS volume FROM raw_flaring)
        WHERE operator IS NOT NULL AND volume IS NOT NULL GROUP BY operator""",
    "silver_production": """
        SELECT p.api_number, COALESCE(p.well_name, w.well_name) AS well_name, operator, production_month,
               CAST(year(production_month) AS INTEGER) AS production_year,
               'Q' || CAST(quarter(production_month) AS VARCHAR) AS production_quarter,
               oil_and_gas_group, production, shale_play, basin, well_length_ft
        FROM silver_facts p LEFT JOIN silver_wells w ON p.api_number = w.api_number""",
    # --- panels
    "wide": """
        SELECT api_number, well_name, operator, shale_play, production_month,
               COALESCE(SUM(production) FILTER (WHERE oil_and_gas_group = 'O'), 0.0) AS oil_production,
               COALESCE(SUM(production) FILTER (WHERE oil_and_gas_group = 'G'), 0.0) AS gas_production
        FROM production GROUP BY api_number, well_name, operator, shale_play, production_month""",
    "ranked_wells": """
        SELECT api_number, SUM(oil_production) AS cum_oil,
               ROW_NUMBER() OVER (ORDER BY SUM(oil_production) DESC, api_number) AS rn
        FROM wide GROUP BY api_number""",
    "upper_panels": """
        SELECT 'operator' AS entity_type, operator AS entity_id, production_month,
               SUM(oil_production) AS oil_production, SUM(gas_production) AS gas_production
        FROM wide GROUP BY operator, production_month
        UNION ALL
        SELECT 'basin', shale_play, production_month, SUM(oil_production), SUM(gas_production)
        FROM wide GROUP BY shale_play, production_month""",
    "measured": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_type, entity_id ORDER BY production_month, oil_production, gas_production) - 1 AS t,
               greatest(oil_production, 0.001) AS q
        FROM (SELECT 'well' AS entity_type, api_number AS entity_id, production_month, oil_production, gas_production
              FROM wide UNION ALL SELECT * FROM upper_panels)
        QUALIFY COUNT(*) OVER (PARTITION BY entity_type, entity_id) >= 6""",
    "measured_calendar": """
        SELECT *, CAST(date_diff('month', MIN(production_month) OVER (PARTITION BY entity_type, entity_id), production_month) AS BIGINT) AS t,
               greatest(oil_production, 0.001) AS q
        FROM (SELECT entity_type, entity_id, production_month, SUM(oil_production) AS oil_production
              FROM (SELECT 'well' AS entity_type, api_number AS entity_id, production_month, oil_production
                    FROM wide UNION ALL SELECT entity_type, entity_id, production_month, oil_production FROM upper_panels)
              GROUP BY entity_type, entity_id, production_month)
        QUALIFY COUNT(*) OVER (PARTITION BY entity_type, entity_id) >= 6""",
    # --- noise-free decline series and their true future
    "parameters": """
        SELECT CAST(s_suppkey AS VARCHAR) AS api_number, s_name AS well_name, n_name AS operator,
               r_name AS shale_play, ln(s_acctbal + 1100) * 1000 AS qi,
               CAST(0.03 AS DOUBLE) + CAST(0.02 AS DOUBLE) * r_regionkey AS di,
               CASE r_regionkey WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 4 THEN CAST(1 AS DOUBLE)
                    ELSE CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * r_regionkey END AS b
        FROM wells_of""",
    "last_t": """
        SELECT max((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) AS t FROM lineitem""",
    "months": "SELECT CAST(unnest(range(0, (SELECT t FROM last_t) + 1)) AS INTEGER) AS t",
    "history": """
        SELECT api_number, operator, shale_play, t,
               CAST(DATE '1995-01-01' + to_months(t) AS DATE) AS production_month,
               qi * CASE WHEN b = 0 THEN exp(-di * t) ELSE pow(1 + b * di * t, -1 / NULLIF(b, 0)) END AS oil
        FROM parameters CROSS JOIN months""",
    "top_decline": f"""
        SELECT api_number FROM (SELECT api_number, ROW_NUMBER() OVER (ORDER BY SUM(oil) DESC, api_number) AS rn
                                FROM history GROUP BY api_number) WHERE rn <= {TOP_WELLS}""",
    "entities": """
        SELECT 'well' AS entity_type, api_number AS entity_id, qi, di, b
        FROM parameters
        UNION ALL SELECT 'operator', operator, SUM(qi), any_value(di), any_value(b) FROM parameters GROUP BY operator
        UNION ALL SELECT 'basin', shale_play, SUM(qi), any_value(di), any_value(b) FROM parameters GROUP BY shale_play""",
    "fits": """
        SELECT *, CASE WHEN b = 0 THEN 'exponential' WHEN b = 1 THEN 'harmonic' ELSE 'hyperbolic' END AS model
        FROM entities""",
    "forecast": """
        SELECT entity_type, entity_id, CAST(DATE '1995-01-01' + to_months(CAST(t AS INTEGER)) AS DATE) AS forecast_month,
               rate AS forecast_oil_bbl, 4 * rate AS forecast_gas_mcf, model AS model_type,
               CAST(1 AS DOUBLE) AS r2_score, qi, di, b AS b_factor
        FROM (SELECT *, qi * CASE WHEN b = 0 THEN exp(-di * t) ELSE pow(1 + b * di * t, -1 / NULLIF(b, 0)) END AS rate
              FROM fits CROSS JOIN (SELECT (SELECT t FROM last_t) + unnest(range(1, 25)) AS t))""",
    "scores": """
        SELECT api_number, CASE WHEN tot > 0 THEN 1 - res / tot ELSE 0 END AS r2
        FROM (SELECT api_number, SUM(pow(production - predicted, 2)) AS res, SUM(pow(production - mean, 2)) AS tot
              FROM (SELECT *, AVG(production) OVER (PARTITION BY api_number) AS mean,
                           60000 * exp(CAST(-0.001 AS DOUBLE)
                               * ((year(production_month) - 1995) * 12 + month(production_month) - 1)) AS predicted
                    FROM production) GROUP BY api_number)""",
}


def sql(text: str, ctes: dict[str, str] = CTES) -> str:
    """Prefix ``text`` with the building blocks it uses, in order of definition."""
    needed: set[str] = set()
    pending = [text]
    while pending:
        words = set(re.findall(r"\b[a-z_0-9]+\b", pending.pop()))
        for name in ctes.keys() & words - needed:
            needed.add(name)
            pending.append(ctes[name])
    chosen = ",\n".join(f"{name} AS ({ctes[name]})" for name in ctes if name in needed)
    return f"WITH {chosen}\n{text}" if chosen else text


def rounded(text: str, columns: str = "") -> str:
    """Round the named double columns the way the queries do."""
    if not columns:
        return text
    replaced = ", ".join(f'round("{c}", {DECIMALS}) AS "{c}"' for c in columns.split())
    return f"SELECT * REPLACE ({replaced}) FROM ({text})"


_PERF = "total_oil_bbl avg_monthly_production total_gas_mcf total_flaring_mcf flaring_intensity_ratio"
_TRENDS = "total_production prev_month_production mom_growth_pct yoy_growth_pct"
_SUMMARY = "cumulative_oil_bbl cumulative_gas_mcf peak_oil_production well_length_ft"
_PANEL = "oil_production gas_production"
_FORECAST = "forecast_oil_bbl forecast_gas_mcf r2_score qi di b_factor"
_ETHANE = "liquid_rich_production dry_gas_production ethane_dry_gas_ratio"
_LINEAGE = "'{file}' AS source_file, '{source}' AS data_source"


def _ingested(cte: str, file: str, source: str = "public_feed") -> str:
    return f"SELECT *, {_LINEAGE.format(file=file, source=source)} FROM {cte}"


def _dedup(source: str, keys: str, order: str) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"""


def _missing(column: str) -> str:
    return f"COUNT(*) FILTER (WHERE {column} IS NULL OR {column} = '') AS {column}"


def _human(value: str, suffix: str = "") -> str:
    return f"""CASE WHEN {value} IS NULL THEN '—'
        WHEN abs({value}) >= 1e9 THEN printf('%.1f', {value} / CAST(1e9 AS DOUBLE)) || 'B{suffix}'
        WHEN abs({value}) >= 1e6 THEN printf('%.1f', {value} / CAST(1e6 AS DOUBLE)) || 'M{suffix}'
        WHEN abs({value}) >= 1e3 THEN printf('%.1f', {value} / CAST(1e3 AS DOUBLE)) || 'K{suffix}'
        ELSE printf('%.1f', CAST({value} AS DOUBLE)) || '{suffix}' END"""


def _titled(value: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all(lower({value}), '[a-z]+|[^a-z]+'),
        lambda run: upper(run[1]) || run[2:]), '')"""


def _curve(rate: str) -> str:
    return rounded(
        f"SELECT api_number, t, {rate} AS rate FROM (SELECT * FROM parameters CROSS JOIN months)", "rate"
    )


def _counts(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST(({count}) AS BIGINT) AS row_count"
        for name, count in tables.items()
    )


def _rows(source: str) -> str:
    return f"SELECT COUNT(*) FROM {source}"


def _grid_fit(source: str) -> str:
    """The best cell of the grid for every series of a CTE with columns entity, t and q."""
    return rounded(
        f"""SELECT entity_type, entity_id,
                   CASE WHEN gb = 0 THEN 'exponential' WHEN gb = 1 THEN 'harmonic' ELSE 'hyperbolic' END AS model,
                   best_qi AS qi, gdi AS di, gb AS b, CASE WHEN tot > 0 THEN 1 - sse / tot ELSE 0 END AS r2
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_type, entity_id ORDER BY sse, gb, gdi) AS rn
                  FROM (SELECT entity_type, entity_id, gdi, gb, any_value(best_qi) AS best_qi,
                               SUM(pow(q - best_qi * f, 2)) AS sse, SUM(pow(q - mean, 2)) AS tot
                        FROM (SELECT *, least(SUM(q * f) OVER cell / SUM(f * f) OVER cell,
                                              10 * first_value(q) OVER (PARTITION BY entity_type, entity_id, gdi, gb ORDER BY t))
                                        AS best_qi, AVG(q) OVER cell AS mean
                              FROM (SELECT entity_type, entity_id, gdi, gb, t, q,
                                           CASE WHEN gb = 0 THEN exp(-gdi * t)
                                                ELSE pow(1 + gb * gdi * t, -1 / NULLIF(gb, 0)) END AS f
                                    FROM {source}
                                    CROSS JOIN (SELECT CAST(unnest({DI_GRID}) AS DOUBLE) AS gdi)
                                    CROSS JOIN (SELECT CAST(unnest({B_GRID}) AS DOUBLE) AS gb))
                              WINDOW cell AS (PARTITION BY entity_type, entity_id, gdi, gb))
                        GROUP BY entity_type, entity_id, gdi, gb)) WHERE rn = 1""",
        "qi di b r2",
    )


_BRONZE = {
    "bronze_flaring": _rows("raw_flaring"),
    "bronze_operator_well_counts": _rows("raw_counts"),
    "bronze_shale_production": _rows("raw_shale"),
    "bronze_well_metadata": _rows("raw_wells"),
    "bronze_well_production": _rows("raw_production"),
}
_SILVER = {
    "silver_wells": _rows("silver_wells"),
    "silver_flaring": _rows("silver_flaring"),
    "silver_production": _rows("silver_production"),
}
_GOLD = {
    "gold_operator_performance": "SELECT COUNT(DISTINCT operator) FROM silver_facts",
    "gold_basin_production_trends":
        "SELECT COUNT(*) FROM (SELECT DISTINCT shale_play, production_month, oil_and_gas_group FROM silver_facts)",
    "gold_flaring_intensity": _rows("silver_flaring"),
    "gold_ethane_dry_gas":
        "SELECT COUNT(*) FROM (SELECT DISTINCT operator, production_year, shale_play FROM silver_production)",
    "gold_well_summary": """SELECT COUNT(*) FROM (SELECT DISTINCT api_number, well_name, operator, shale_play
        FROM silver_production WHERE oil_and_gas_group = 'O')""",
}
_FORECAST_ROWS = {
    "gold_production_forecast": """
        SELECT 24 * COUNT(*) FROM (
            SELECT api_number FROM (
                SELECT api_number, COUNT(*) AS n
                FROM (SELECT api_number, well_name, operator, production_month,
                             COALESCE(SUM(production) FILTER (WHERE oil_and_gas_group = 'O'), 0) AS oil
                      FROM silver_production GROUP BY ALL) GROUP BY api_number) WHERE n >= 6
            UNION ALL SELECT operator FROM silver_production GROUP BY operator
              HAVING COUNT(DISTINCT production_month) >= 6
            UNION ALL SELECT shale_play FROM silver_production GROUP BY shale_play
              HAVING COUNT(DISTINCT production_month) >= 6)""",
}

def _outcomes(parts: tuple[str, str, str, str, str]) -> str:
    """Outcomes of a feed: its table, raw columns, typed columns with the reason, key, other typed columns."""
    table, raw, typed, key, rest = parts
    order = ", ".join(f"{c} NULLS FIRST" for c in f"{rest}, {raw}".split(", "))
    same = " AND ".join(f"{c} IS NOT DISTINCT FROM FIRST_VALUE({c}) OVER best" for c in rest.split(", "))
    columns = ", ".join(f"{c} AS {c.removeprefix('r_')}" for c in raw.split(", "))
    return f"""SELECT {columns}, outcome, COUNT(*) AS rows FROM (
            SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN ROW_NUMBER() OVER best = 1 THEN 'kept'
                           WHEN {same} THEN 'copy' ELSE 'superseded' END AS outcome
            FROM (SELECT {typed} FROM {table})
            WINDOW best AS (PARTITION BY reason IS NULL, {key} ORDER BY {order}))
        GROUP BY {raw}, outcome"""


_PRODUCTION_OUTCOMES = (
    "raw_production",
    "r_api_number, r_well_name, r_operator, r_production_month, r_oil_and_gas_group, r_production, r_shale_play, r_basin",
    """api_number AS r_api_number, well_name AS r_well_name, operator AS r_operator, production_month AS r_production_month,
       oil_and_gas_group AS r_oil_and_gas_group, production AS r_production, shale_play AS r_shale_play, basin AS r_basin,
       trim(upper(operator)) AS t_operator, CAST(try_strptime(production_month, '%Y-%m-%d') AS DATE) AS t_month, TRY_CAST(production AS DOUBLE) AS t_production,
       CASE WHEN api_number IS NULL THEN 'no api_number' WHEN t_month IS NULL THEN 'unreadable month' WHEN t_operator IS NULL THEN 'no operator'
            WHEN t_production IS NULL THEN 'unreadable volume' WHEN t_production < 0 THEN 'negative volume' END AS reason""",
    "r_api_number, t_month, r_oil_and_gas_group",
    "r_well_name, t_operator, t_production, r_shale_play, r_basin",
)
_WELLS_OUTCOMES = (
    "raw_wells",
    "r_squarerootsum, r_well_name, r_api_number",
    """squarerootsum AS r_squarerootsum, well_name AS r_well_name, api_number AS r_api_number, TRY_CAST(squarerootsum AS DOUBLE) AS t_length,
       CASE WHEN api_number IS NULL THEN 'no api_number' END AS reason""",
    "r_api_number",
    "r_well_name, t_length",
)
_FLARING_OUTCOMES = (
    "raw_flaring",
    "r_operator, r_totalflaredgas_mcf",
    """operator AS r_operator, totalflaredgas_mcf AS r_totalflaredgas_mcf, trim(upper(operator)) AS t_operator,
       TRY_CAST(replace(totalflaredgas_mcf, ',', '') AS DOUBLE) AS t_volume,
       CASE WHEN t_operator IS NULL THEN 'no operator' WHEN t_volume IS NULL THEN 'unreadable volume' END AS reason""",
    "t_operator",
    "t_volume",
)


def _closed(placed: str) -> str:
    """Sums of events placed in windows, for those windows that the watermark has passed."""
    return rounded(
        f"""SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(window_start + size, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
                   event_type, COUNT(*) AS events, SUM(value) AS value
            FROM ({placed}) WHERE window_start + size <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)
            GROUP BY window_start, size, event_type""",
        "value",
    )


_TOP_WELLS = "SELECT api_number FROM ranked_wells WHERE rn <= {n}"
_WELL_PANEL = (
    "SELECT 'well' AS entity_type, api_number AS entity_id, production_month, oil_production, "
    "gas_production FROM wide"
)

_TEXTS = {
    # sources and sinks
    "scan_csv_strings": "SELECT * FROM raw_production",
    "ingest_flaring": _ingested("raw_flaring", "flaring.csv"),
    "ingest_operator_well_counts": _ingested("raw_counts", "operator_well_counts.csv"),
    "ingest_shale_production": _ingested("raw_shale", "shale_play_production.csv"),
    "ingest_well_metadata": _ingested("raw_wells", "well_metadata.csv"),
    "ingest_well_production": "SELECT *, true AS ingest_year_is_load_year FROM (" + _ingested(
        "raw_production", "synthetic_well_production.csv", "modelled_feed"
    ) + ")",
    "write_overwrite": rounded("SELECT * FROM flaring", "total_flared_gas_mcf"),
    "write_partitioned": rounded(
        """SELECT production_year, COUNT(*) AS row_count,
                  SUM(CASE WHEN production_year = 1996 THEN 2 * production ELSE production END) AS production
           FROM production GROUP BY production_year""",
        "production",
    ),
    "scan_table": rounded("SELECT * FROM supplier", "s_acctbal"),
    "table_counts": _counts(
        {name: _rows(name) for name in ("lineitem", "nation", "orders", "region", "supplier")}
    ),
    "register_views": rounded(
        """SELECT operator, total_flared_gas_mcf, SUM(production) AS total_production
           FROM production JOIN flaring USING (operator) GROUP BY operator, total_flared_gas_mcf""",
        "total_flared_gas_mcf total_production",
    ),
    "load_kpi_sample": rounded("SELECT * FROM ethane", _ETHANE),
    "load_trends_sample": rounded("SELECT * FROM trends", _TRENDS),
    # cleaning
    "sanitize_columns": "SELECT * FROM raw_wells",
    "add_lineage": _ingested("raw_flaring", "flaring.csv"),
    "normalize_operator": """SELECT trim(upper(operator)) AS operator, COUNT(*) AS row_count
        FROM raw_production GROUP BY trim(upper(operator))""",
    "filter_not_null": """SELECT api_number, well_name, production_month FROM raw_production
        WHERE well_name IS NOT NULL AND production_month IS NOT NULL""",
    "filter_non_negative": rounded(
        """SELECT api_number, TRY_CAST(production AS DOUBLE) AS production FROM raw_production
           WHERE TRY_CAST(production AS DOUBLE) >= 0""",
        "production",
    ),
    "clean_production": rounded("SELECT * FROM silver_facts", "production"),
    "clean_flaring": rounded("SELECT * FROM silver_flaring", "total_flared_gas_mcf"),
    "clean_wells": rounded("SELECT * FROM silver_wells", "well_length_ft"),
    "enrich_production": rounded("SELECT * FROM silver_production", "production well_length_ft"),
    "dedup_wells": _dedup("raw_wells", "api_number", "squarerootsum, well_name"),
    "dedup_flaring": _dedup("raw_flaring", "operator", "totalflaredgas_mcf"),
    "dedup_production": _dedup(
        "raw_production", "api_number, production_month, oil_and_gas_group",
        "well_name NULLS FIRST, operator, production",
    ),
    # quality
    "dq_null_profile": "SELECT " + ", ".join(
        _missing(c)
        for c in ("api_number", "well_name", "operator", "production_month", "oil_and_gas_group",
                  "production", "shale_play", "basin")
    ) + " FROM raw_production",
    "dq_summary": rounded(
        """SELECT *, clean_rows / CAST(raw_rows AS DOUBLE) * 100 AS retention_pct FROM (
             SELECT (SELECT COUNT(*) FROM raw_production) AS raw_rows, COUNT(*) AS clean_rows,
                    COUNT(DISTINCT api_number) AS unique_wells, COUNT(DISTINCT operator) AS unique_operators,
                    MIN(production_month) AS first_month, MAX(production_month) AS last_month,
                    COUNT(*) FILTER (WHERE production IS NULL) AS null_productions,
                    (SELECT COUNT(*) FROM typed_production WHERE isnan(production) OR isinf(production)) AS non_finite
             FROM silver_facts)""",
        "retention_pct",
    ),
    "input_profile": """SELECT COUNT(*) AS row_count, COUNT(DISTINCT api_number) AS well_count,
        MIN(production_month) AS first_month, MAX(production_month) AS last_month FROM raw_production""",
    "rows_per_partition": """SELECT production_year, COUNT(*) AS "count" FROM production GROUP BY production_year""",
    "rows_per_commodity": """SELECT oil_and_gas_group, COUNT(*) AS "count" FROM raw_production GROUP BY oil_and_gas_group""",
    "distinct_operators": "SELECT DISTINCT operator FROM production",
    "distinct_wells": "SELECT DISTINCT api_number FROM production",
    "operator_quarterly": rounded(
        """SELECT operator, production_year, production_quarter, oil_and_gas_group,
                  ROUND(SUM(production), 2) AS total_production, COUNT(DISTINCT api_number) AS active_wells
           FROM production GROUP BY operator, production_year, production_quarter, oil_and_gas_group""",
        "total_production",
    ),
    "avg_yoy_growth": rounded(
        """SELECT shale_play, oil_and_gas_group, ROUND(AVG(yoy_growth_pct), 2) AS avg_yoy_growth_pct
           FROM trends WHERE yoy_growth_pct IS NOT NULL GROUP BY shale_play, oil_and_gas_group""",
        "avg_yoy_growth_pct",
    ),
    "top5_flaring_intensity": rounded(
        """SELECT operator, ROUND(flaring_intensity_ratio, 2) AS flaring_pct, flaring_category, flaring_rank
           FROM intensity WHERE flaring_intensity_ratio IS NOT NULL ORDER BY flaring_rank, operator LIMIT 5""",
        "flaring_pct",
    ),
    # KPI tables
    "operator_performance": rounded("SELECT * FROM perf", _PERF),
    "basin_production_trends": rounded("SELECT * FROM trends", _TRENDS),
    "flaring_intensity": rounded(
        "SELECT * FROM intensity", "total_flared_gas_mcf total_gas_production_mcf flaring_intensity_ratio"
    ),
    "ethane_dry_gas": rounded("SELECT * FROM ethane", _ETHANE),
    "well_summary": rounded("SELECT * FROM summary", _SUMMARY),
    "filter_commodity": rounded(
        "SELECT * FROM production WHERE oil_and_gas_group = 'O'", "production well_length_ft"
    ),
    "operator_oil_rollup": rounded("SELECT * FROM oil", "total_oil_bbl avg_monthly_production"),
    "operator_gas_rollup": rounded("SELECT * FROM gas", "total_gas_mcf"),
    "operator_oil_gas_outer": rounded(
        "SELECT * FROM oil FULL JOIN gas USING (operator)",
        "total_oil_bbl avg_monthly_production total_gas_mcf",
    ),
    "basin_monthly": rounded("SELECT * FROM monthly", "total_production"),
    "basin_mom": rounded(
        """SELECT shale_play, production_month, oil_and_gas_group, total_production,
                  prev_month_production, mom_growth_pct FROM trends""",
        "total_production prev_month_production mom_growth_pct",
    ),
    "basin_yoy": rounded(
        """SELECT shale_play, production_month, oil_and_gas_group, total_production, yoy_growth_pct
           FROM trends""",
        "total_production yoy_growth_pct",
    ),
    "basin_rank": rounded(
        """SELECT shale_play, production_month, oil_and_gas_group, total_production, production_rank
           FROM trends""",
        "total_production",
    ),
    "well_lifetime": rounded(
        "SELECT * FROM lifetime", "well_length_ft cumulative_oil_bbl peak_oil_production"
    ),
    "well_gas_total": rounded("SELECT * FROM well_gas", "cumulative_gas_mcf"),
    "well_peak_month": "SELECT * FROM peak",
    "operator_rank": rounded(
        "SELECT operator, total_oil_bbl, production_rank FROM perf", "total_oil_bbl"
    ),
    "flaring_rank": rounded(
        "SELECT operator, flaring_intensity_ratio, flaring_rank FROM intensity", "flaring_intensity_ratio"
    ),
    "flaring_category": "SELECT operator, flaring_category FROM intensity",
    "basin_category": "SELECT operator, production_year, shale_play, basin_category FROM ethane",
    "safe_ratio": rounded(
        """SELECT operator, CASE WHEN total_gas_mcf > 0 THEN total_oil_bbl / total_gas_mcf END AS oil_gas_ratio
           FROM perf""",
        "oil_gas_ratio",
    ),
    "quarter_label": """SELECT DISTINCT production_month, production_year,
        CAST(month(production_month) AS INTEGER) AS month_number, production_quarter FROM production""",
    # portfolio
    "portfolio_kpis": rounded(
        """SELECT SUM(total_oil_bbl) AS total_oil, SUM(total_gas_mcf) AS total_gas,
                  COUNT(DISTINCT operator) AS n_operators,
                  (SELECT COUNT(DISTINCT api_number) FROM summary) AS n_wells FROM perf""",
        "total_oil total_gas",
    ),
    "top10_operators": rounded(
        "SELECT * FROM perf WHERE total_oil_bbl IS NOT NULL ORDER BY total_oil_bbl DESC, operator LIMIT 10",
        _PERF,
    ),
    "oil_gas_mix": rounded(
        """SELECT operator, total_oil_bbl, total_gas_mcf, well_count, flaring_intensity_ratio FROM perf
           WHERE total_oil_bbl IS NOT NULL AND total_gas_mcf IS NOT NULL""",
        "total_oil_bbl total_gas_mcf flaring_intensity_ratio",
    ),
    "wells_per_play": "SELECT shale_play, COUNT(api_number) AS wells FROM summary GROUP BY shale_play",
    "well_portfolio": f"""SELECT well_name AS "Well Name", operator AS "Operator", shale_play AS "Shale Play",
        basin AS "Basin", first_production_month AS "First Production Month",
        last_production_month AS "Last Production Month", {_human("cumulative_oil_bbl")} AS "Cumulative Oil Bbl",
        {_human("cumulative_gas_mcf")} AS "Cumulative Gas Mcf", {_human("peak_oil_production")}
        AS "Peak Oil Production", active_months AS "Active Months" FROM summary""",
    "trend_slice": rounded(
        f"SELECT * FROM trends WHERE shale_play IN ('{PLAY}', 'ASIA') AND oil_and_gas_group = 'O'", _TRENDS
    ),
    "growth_series": rounded(
        """SELECT shale_play, oil_and_gas_group, production_month, mom_growth_pct FROM trends
           WHERE mom_growth_pct IS NOT NULL""",
        "mom_growth_pct",
    ),
    "basin_trends_calendar": rounded(
        """SELECT t.shale_play, t.production_month, t.oil_and_gas_group, t.total_production, m.total_production AS prev_month_production,
                  CASE WHEN m.total_production > 0 THEN (t.total_production - m.total_production) / m.total_production * 100 END AS mom_growth_pct,
                  CASE WHEN y.total_production > 0 THEN (t.total_production - y.total_production) / y.total_production * 100 END AS yoy_growth_pct,
                  t.production_rank
           FROM trends t
           LEFT JOIN trends m ON m.shale_play = t.shale_play AND m.oil_and_gas_group = t.oil_and_gas_group
                             AND m.production_month + INTERVAL 1 MONTH = t.production_month
           LEFT JOIN trends y ON y.shale_play = t.shale_play AND y.oil_and_gas_group = t.oil_and_gas_group
                             AND y.production_month + INTERVAL 1 YEAR = t.production_month""",
        _TRENDS,
    ),
    "well_trends_calendar": rounded(
        """WITH w AS (SELECT api_number, oil_and_gas_group, production_month, SUM(production) AS total_production
                      FROM production GROUP BY ALL)
           SELECT t.api_number, t.oil_and_gas_group, t.production_month, t.total_production, m.total_production AS prev_month_production,
                  CASE WHEN m.total_production > 0 THEN (t.total_production - m.total_production) / m.total_production * 100 END AS mom_growth_pct,
                  CASE WHEN y.total_production > 0 THEN (t.total_production - y.total_production) / y.total_production * 100 END AS yoy_growth_pct
           FROM w t
           LEFT JOIN w m ON m.api_number = t.api_number AND m.oil_and_gas_group = t.oil_and_gas_group
                        AND m.production_month + INTERVAL 1 MONTH = t.production_month
           LEFT JOIN w y ON y.api_number = t.api_number AND y.oil_and_gas_group = t.oil_and_gas_group
                        AND y.production_month + INTERVAL 1 YEAR = t.production_month""",
        "total_production prev_month_production mom_growth_pct yoy_growth_pct",
    ),
    "quarter_matrix": "SELECT CAST(year(production_month) AS INTEGER) AS production_year, "
    + ", ".join(
        f"""round(coalesce(sum(production) FILTER (year(production_month) = {year} AND quarter(production_month) = {quarter}), 0.0), {DECIMALS}) AS "{year}Q{quarter}\""""
        for year in range(1995, 2002)  # the years of the supplied tables
        for quarter in range(1, 5)
    )
    + " FROM production WHERE oil_and_gas_group = 'O' GROUP BY 1",
    "yoy_series": rounded(
        """SELECT shale_play, oil_and_gas_group, production_month, yoy_growth_pct FROM trends
           WHERE yoy_growth_pct IS NOT NULL""",
        "yoy_growth_pct",
    ),
    "well_history": rounded(
        f"""SELECT production_month, SUM(oil_production) AS oil_production, SUM(gas_production) AS gas_production
            FROM wide WHERE api_number = '{WELL}' GROUP BY production_month""",
        _PANEL,
    ),
    "operator_history": rounded(
        f"""SELECT production_month, SUM(oil_production) AS oil_production, SUM(gas_production) AS gas_production
            FROM wide WHERE operator = '{OPERATOR}' GROUP BY production_month""",
        _PANEL,
    ),
    "distinct_plays": "SELECT DISTINCT shale_play FROM production",
    "trends_scaled": """SELECT shale_play, production_month,
        CAST(CAST(total_production / 1000 AS DECIMAL(20,5)) AS VARCHAR) AS thousand_bbl FROM trends
        WHERE oil_and_gas_group = 'O'""",
    "commodity_split_scaled": rounded(
        """SELECT operator, liquid / 1000000 AS liquid_rich_millions, dry / 1000000 AS dry_gas_millions FROM (
             SELECT operator, COALESCE(SUM(liquid_rich_production), 0) AS liquid,
                    COALESCE(SUM(dry_gas_production), 0) AS dry FROM ethane GROUP BY operator)
           ORDER BY liquid + dry DESC, operator LIMIT 14""",
        "liquid_rich_millions dry_gas_millions",
    ),
    "entity_history": rounded(
        f"""SELECT production_month, SUM(oil_production) AS oil_production, SUM(gas_production) AS gas_production
            FROM wide WHERE shale_play = '{PLAY}' GROUP BY production_month""",
        _PANEL,
    ),
    "operator_drilldown": rounded(
        f"""SELECT production_month, oil_and_gas_group, SUM(production) AS production FROM production
            WHERE operator = '{OPERATOR}' GROUP BY production_month, oil_and_gas_group""",
        "production",
    ),
    "flaring_percentiles": rounded("SELECT * FROM cuts", "p33 p67"),
    "volume_tier": rounded("SELECT * FROM tiered", "total_flared_gas_mcf"),
    "flaring_kpis": rounded(
        f"""SELECT SUM(total_flared_gas_mcf) AS total_flared, MAX(total_flared_gas_mcf) AS top_flared_volume,
                  (SELECT operator FROM tiered ORDER BY total_flared_gas_mcf DESC, operator LIMIT 1) AS top_flarer,
                  COUNT(*) AS n_operators, COUNT(*) FILTER (WHERE volume_category = 'High') AS n_high,
                  {_titled("(SELECT operator FROM tiered ORDER BY total_flared_gas_mcf DESC, operator LIMIT 1)")}
                    AS top_flarer_label,
                  MEDIAN(total_flared_gas_mcf) AS median_flared FROM tiered""",
        "total_flared top_flared_volume median_flared",
    ),
    "tier_distribution": "SELECT volume_category, COUNT(*) AS operators FROM tiered GROUP BY volume_category",
    "tier_summary": rounded(
        """SELECT volume_category, COUNT(operator) AS operators, SUM(total_flared_gas_mcf) AS total_flared,
                  AVG(total_flared_gas_mcf) AS avg_flared FROM tiered GROUP BY volume_category""",
        "total_flared avg_flared",
    ),
    "tier_report": f"""SELECT volume_category AS "Tier", operators AS "# Operators", {_human("total")}
        AS "Total Flared", {_human("mean")} AS "Avg per Operator"
        FROM (SELECT volume_category, COUNT(operator) AS operators, SUM(total_flared_gas_mcf) AS total,
                     AVG(total_flared_gas_mcf) AS mean FROM tiered GROUP BY volume_category)""",
    "top10_flaring": rounded(
        f"""SELECT *, {_titled("operator")} AS operator_label FROM tiered
            ORDER BY total_flared_gas_mcf DESC, operator LIMIT 10""",
        "total_flared_gas_mcf",
    ),
    "commodity_split_top_n": rounded(
        """SELECT *, liquid_rich_production + dry_gas_production AS total FROM (
             SELECT operator, COALESCE(SUM(liquid_rich_production), 0) AS liquid_rich_production,
                    COALESCE(SUM(dry_gas_production), 0) AS dry_gas_production FROM ethane GROUP BY operator)
           ORDER BY total DESC, operator LIMIT 14""",
        "liquid_rich_production dry_gas_production total",
    ),
    "liquid_share_by_year": rounded(
        """SELECT *, liquid_rich_production / (liquid_rich_production + dry_gas_production) * 100
                  AS liquid_rich_pct FROM (
             SELECT production_year, SUM(liquid_rich_production) AS liquid_rich_production,
                    SUM(dry_gas_production) AS dry_gas_production FROM ethane GROUP BY production_year)""",
        "liquid_rich_production dry_gas_production liquid_rich_pct",
    ),
    "title_case": f"""SELECT name, {_titled("name")} AS label
        FROM (SELECT c_mktsegment || '-' || upper(c_name) AS name FROM customer)""",
    "humanize_number": f"""SELECT o_orderkey, {_human("o_totalprice", " BBL")} AS price,
        {_human("(o_totalprice * o_totalprice)")} AS "large",
        {_human("(o_totalprice * o_totalprice * CAST(1e17 AS DOUBLE))")} AS huge,
        printf('%.1f', o_totalprice * o_totalprice * o_totalprice * o_totalprice) AS all_digits,
        {_human("(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END)")} AS "small" FROM orders""",
    "entity_labels": """SELECT api_number, left(COALESCE(well_name, api_number), 20) AS short_name,
        right(well_name, 6) AS tail, shale_play AS play FROM summary""",
    "horizon_label": """SELECT api_number, strftime(last_production_month, '%b %Y') AS horizon FROM summary""",
    # panels
    "monthly_wide_panel": rounded("SELECT * FROM wide", _PANEL),
    "operator_monthly": rounded(
        """SELECT operator, production_month, SUM(oil_production) AS oil_production,
                  SUM(gas_production) AS gas_production FROM wide GROUP BY operator, production_month""",
        _PANEL,
    ),
    "play_monthly": rounded(
        """SELECT shale_play, production_month, SUM(oil_production) AS oil_production,
                  SUM(gas_production) AS gas_production FROM wide GROUP BY shale_play, production_month""",
        _PANEL,
    ),
    "play_monthly_oil": rounded(
        """SELECT shale_play, production_month, SUM(production) AS total_oil FROM production
           WHERE oil_and_gas_group = 'O' GROUP BY shale_play, production_month""",
        "total_oil",
    ),
    "top_wells": rounded(f"SELECT api_number, cum_oil FROM ranked_wells WHERE rn <= {TOP_WELLS}", "cum_oil"),
    "top3_wells": rounded(
        """SELECT api_number, well_name, SUM(production) AS cum_oil FROM production
           WHERE oil_and_gas_group = 'O' GROUP BY api_number, well_name
           ORDER BY cum_oil DESC, api_number, well_name LIMIT 3""",
        "cum_oil",
    ),
    "top_wells_semi": rounded(
        f"SELECT * FROM wide WHERE api_number IN ({_TOP_WELLS.format(n=20)})", _PANEL
    ),
    "entity_panel": rounded(
        f"""{_WELL_PANEL} WHERE api_number IN ({_TOP_WELLS.format(n=20)})
            UNION ALL SELECT * FROM upper_panels""",
        _PANEL,
    ),
    "entity_panel_grouping_sets": rounded(f"{_WELL_PANEL} UNION ALL SELECT * FROM upper_panels", _PANEL),
    # decline curves
    "arps_exponential": _curve("qi * exp(-di * t)"),
    "arps_hyperbolic": _curve(
        "qi / pow(1 + (b * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE)) * di * t,"
        " 1 / (b * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE)))"
    ),
    "arps_harmonic": _curve("qi / (1 + di * t)"),
    "r2_score": rounded("SELECT * FROM scores", "r2"),
    "r2_histogram": rounded(
        """SELECT CAST(bins.bin AS INTEGER) AS bin, low + bins.bin * (high - low) / 30 AS bin_low,
                  low + (bins.bin + 1) * (high - low) / 30 AS bin_high, COALESCE(n, 0) AS wells, mean AS mean_r2
           FROM (SELECT unnest(range(0, 30)) AS bin) bins
           CROSS JOIN (SELECT min(round(r2, 9)) AS low, max(round(r2, 9)) AS high,
                              avg(round(r2, 9)) AS mean FROM scores) bounds
           LEFT JOIN (SELECT least(floor((round(r2, 9) - lo) * 30 / (hi - lo)), 29) AS bin, COUNT(*) AS n
                      FROM scores CROSS JOIN (SELECT min(round(r2, 9)) AS lo, max(round(r2, 9)) AS hi FROM scores) e
                      GROUP BY 1) counts ON bins.bin = counts.bin""",
        "bin_low bin_high mean_r2",
    ),
    "best_model": rounded(
        """SELECT api_number, CASE WHEN b = 0 THEN 'exponential' WHEN b = 1 THEN 'harmonic' ELSE 'hyperbolic' END
                  AS model, CAST(1 AS DOUBLE) AS r2 FROM parameters""",
        "r2",
    ),
    "arps_fit": rounded(
        """SELECT entity_type, entity_id, CAST((SELECT t FROM last_t) + 1 AS INTEGER) AS months,
                  g AS oil_and_gas_group, model, CASE g WHEN 'O' THEN qi ELSE 4 * qi END AS qi, di, b,
                  CAST(1 AS DOUBLE) AS r2
           FROM fits CROSS JOIN (SELECT unnest(['O', 'G']) AS g)""",
        "qi di b r2",
    ),
    "arps_grid_fit": rounded(
        f"""SELECT entity_type, entity_id,
                   CASE WHEN gb = 0 THEN 'exponential' WHEN gb = 1 THEN 'harmonic' ELSE 'hyperbolic' END AS model,
                   best_qi AS qi, gdi AS di, gb AS b, 1 - sse / tot AS r2
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_type, entity_id ORDER BY sse, gb, gdi) AS rn
                  FROM (SELECT entity_type, entity_id, gdi, gb, any_value(best_qi) AS best_qi,
                               SUM(pow(q - best_qi * f, 2)) AS sse, SUM(pow(q - mean, 2)) AS tot
                        FROM (SELECT *, least(SUM(q * f) OVER cell / SUM(f * f) OVER cell, 10 * max(q) OVER cell)
                                        AS best_qi, AVG(q) OVER cell AS mean
                              FROM (SELECT entity_type, entity_id, gdi, gb,
                                           qi * CASE WHEN b = 0 THEN exp(-di * t)
                                                     ELSE pow(1 + b * di * t, -1 / NULLIF(b, 0)) END AS q,
                                           CASE WHEN gb = 0 THEN exp(-gdi * t)
                                                ELSE pow(1 + gb * gdi * t, -1 / NULLIF(gb, 0)) END AS f
                                    FROM entities CROSS JOIN months
                                    CROSS JOIN (SELECT CAST(unnest({DI_GRID}) AS DOUBLE) AS gdi)
                                    CROSS JOIN (SELECT CAST(unnest({B_GRID}) AS DOUBLE) AS gb))
                              WINDOW cell AS (PARTITION BY entity_type, entity_id, gdi, gb))
                        GROUP BY entity_type, entity_id, gdi, gb)) WHERE rn = 1""",
        "qi di b r2",
    ),
    "arps_grid_fit_measured": _grid_fit("measured"),
    "arps_grid_fit_calendar": _grid_fit("measured_calendar"),
    "fit_against_grid": """SELECT entity_type, entity_id, g AS oil_and_gas_group, CAST(n AS INTEGER) AS months, true AS at_least_grid
        FROM (SELECT entity_type, entity_id, COUNT(*) AS n FROM measured GROUP BY entity_type, entity_id)
        CROSS JOIN (SELECT unnest(['O', 'G']) AS g)""",
    "fit_against_grid_calendar": """SELECT entity_type, entity_id, g AS oil_and_gas_group, CAST(n AS INTEGER) AS months, true AS at_least_grid
        FROM (SELECT entity_type, entity_id, COUNT(*) AS n FROM measured_calendar GROUP BY entity_type, entity_id)
        CROSS JOIN (SELECT unnest(['O', 'G']) AS g)""",
    "forecast_months_calendar": rounded(
        """SELECT entity_type, entity_id, CAST(last_month + to_months(CAST(step AS INTEGER)) AS DATE) AS forecast_month,
                  exp(CAST(-0.01 AS DOUBLE) * (last_t + step)) AS forecast_oil_bbl
           FROM (SELECT entity_type, entity_id, MAX(production_month) AS last_month, MAX(t) AS last_t
                 FROM measured_calendar GROUP BY entity_type, entity_id)
           CROSS JOIN (SELECT unnest(range(1, 4)) AS step)""",
        "forecast_oil_bbl",
    ),
    "forecast_months_measured": """SELECT entity_type, entity_id, CAST(24 AS BIGINT) AS months,
        CAST(max(production_month) + INTERVAL 1 MONTH AS DATE) AS first_month,
        CAST(max(production_month) + INTERVAL 24 MONTH AS DATE) AS last_month, CAST(0 AS BIGINT) AS negative
        FROM measured GROUP BY entity_type, entity_id""",
    "fitted_curve": rounded(
        """SELECT entity_type, entity_id, t, CAST(DATE '1995-01-01' + to_months(t) AS DATE) AS production_month,
                  rate AS oil_production, 4 * rate AS gas_production, rate AS oil_fitted, 4 * rate AS gas_fitted
           FROM (SELECT *, qi * CASE WHEN b = 0 THEN exp(-di * t)
                                     ELSE pow(1 + b * di * t, -1 / NULLIF(b, 0)) END AS rate
                 FROM entities CROSS JOIN months)""",
        "oil_production gas_production oil_fitted gas_fitted",
    ),
    "project_forward": rounded(
        """SELECT 'well' AS entity_type, api_number AS entity_id,
                  CAST(DATE '1995-01-01' + to_months(CAST(t AS INTEGER)) AS DATE) AS forecast_month,
                  rate AS forecast_oil_bbl, 4 * rate AS forecast_gas_mcf,
                  CASE WHEN b = 0 THEN 'exponential' WHEN b = 1 THEN 'harmonic' ELSE 'hyperbolic' END AS model_type,
                  CAST(1 AS DOUBLE) AS r2_score, qi, di, b AS b_factor
           FROM (SELECT *, qi * CASE WHEN b = 0 THEN exp(-di * t)
                                     ELSE pow(1 + b * di * t, -1 / NULLIF(b, 0)) END AS rate
                 FROM parameters CROSS JOIN (SELECT (SELECT t FROM last_t) + unnest(range(1, 25)) AS t))""",
        _FORECAST,
    ),
    "forecast_calendar": """SELECT l_suppkey, CAST(step AS INTEGER) AS step, last_day,
        CAST(last_day + to_months(CAST(step AS INTEGER)) AS DATE) AS forecast_day
        FROM (SELECT l_suppkey, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY l_suppkey)
        CROSS JOIN (SELECT unnest(range(1, 25)) AS step)""",
    "forecast_wells": rounded("SELECT * FROM forecast WHERE entity_type = 'well' AND entity_id IN (SELECT api_number FROM top_decline)", _FORECAST),
    "forecast_operators": rounded("SELECT * FROM forecast WHERE entity_type = 'operator'", _FORECAST),
    "forecast_plays": rounded("SELECT * FROM forecast WHERE entity_type = 'basin'", _FORECAST),
    "forecast_table": rounded("SELECT * FROM forecast", _FORECAST),
    "forecast_table_gaps": rounded("SELECT * FROM forecast", _FORECAST),
    "arps_fit_gaps": rounded(
        """SELECT entity_type, entity_id, CAST((SELECT COUNT(*) FROM months WHERE t % 12 <> 3) AS INTEGER) AS months,
                  g AS oil_and_gas_group, model, CASE g WHEN 'O' THEN qi ELSE 4 * qi END AS qi, di, b,
                  CAST(1 AS DOUBLE) AS r2
           FROM fits CROSS JOIN (SELECT unnest(['O', 'G']) AS g)""",
        "qi di b r2",
    ),
    "forecast_entity": rounded(
        f"""SELECT * FROM forecast WHERE entity_id = '{OPERATOR}'
            QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_type, entity_id ORDER BY forecast_month) <= 12""",
        _FORECAST,
    ),
    "forecast_band": rounded(
        """SELECT *, forecast_oil_bbl * 0.85 AS oil_low, forecast_oil_bbl * 1.15 AS oil_high,
                  forecast_gas_mcf * 0.85 AS gas_low, forecast_gas_mcf * 1.15 AS gas_high FROM forecast""",
        _FORECAST + " oil_low oil_high gas_low gas_high",
    ),
    "forecast_slice": rounded(
        f"""SELECT *, MIN(forecast_month) OVER () AS forecast_start FROM forecast
            WHERE entity_type = 'operator' AND entity_id = '{OPERATOR}'""",
        _FORECAST,
    ),
    "forecast_kpis": rounded(
        """SELECT avg(r2_score) AS avg_r2, 100.0 * avg(CAST(model_type = 'hyperbolic' AS DOUBLE)) AS pct_hyperbolic,
                  COUNT(DISTINCT entity_id) FILTER (WHERE entity_type = 'well') AS n_wells,
                  COUNT(DISTINCT entity_id) FILTER (WHERE entity_type = 'operator') AS n_operators,
                  COUNT(DISTINCT entity_id) FILTER (WHERE entity_type = 'basin') AS n_basins,
                  strftime(max(forecast_month), '%b %Y') AS horizon FROM forecast""",
        "avg_r2 pct_hyperbolic",
    ),
    "model_mix": """SELECT entity_type, model AS model_type, COUNT(*) AS entities FROM fits
        GROUP BY entity_type, model""",
    "forecast_summary": rounded(
        """SELECT entity_type, entity_id, model_type, r2_score, SUM(forecast_oil_bbl) AS forecast_oil_bbl,
                  SUM(forecast_gas_mcf) AS forecast_gas_mcf FROM forecast
           GROUP BY entity_type, entity_id, model_type, r2_score""",
        "r2_score forecast_oil_bbl forecast_gas_mcf",
    ),
    "forecast_report": f"""SELECT entity_type AS "Type", entity_id AS "Entity", model_type AS "Model",
        '1.0000' AS "R²", {_human("oil")} AS "Forecast Oil", {_human("gas")} AS "Forecast Gas"
        FROM (SELECT entity_type, entity_id, model_type, SUM(forecast_oil_bbl) AS oil, SUM(forecast_gas_mcf) AS gas
              FROM forecast GROUP BY entity_type, entity_id, model_type)""",
    "model_card": f"""SELECT upper(model[1]) || model[2:] AS model, '1.0000' AS r2_score,
        {_human("qi")} AS initial_rate, printf('%.4f', di) || '/month' AS decline_rate
        FROM fits WHERE entity_type = 'operator' AND entity_id = '{OPERATOR}'""",
    "operator_forecast_top": rounded(
        """SELECT entity_id, SUM(forecast_oil_bbl) AS forecast_oil_bbl FROM forecast
           WHERE entity_type = 'operator' GROUP BY entity_id ORDER BY forecast_oil_bbl DESC, entity_id LIMIT 12""",
        "forecast_oil_bbl",
    ),
    # sketches
    "sketch_percentiles": """SELECT shale_play, production_year, oil_and_gas_group, COUNT(*) AS reports,
        true AS p10_within, true AS p50_within, true AS p90_within FROM production GROUP BY ALL""",
    "sketch_wells": """SELECT level, entity, period, COUNT(DISTINCT api_number) AS wells, true AS within FROM (
          SELECT 'operator_quarter' AS level, operator AS entity, production_year || production_quarter AS period, api_number FROM production
          UNION ALL SELECT 'operator_year', operator, CAST(production_year AS VARCHAR), api_number FROM production
          UNION ALL SELECT 'play_year', shale_play, CAST(production_year AS VARCHAR), api_number FROM production
          UNION ALL SELECT 'all', 'all', 'all', api_number FROM production)
        GROUP BY level, entity, period""",
    # reconciliation and broken lines
    "reconcile_production": _outcomes(_PRODUCTION_OUTCOMES),
    "reconcile_wells": _outcomes(_WELLS_OUTCOMES),
    "reconcile_flaring": _outcomes(_FLARING_OUTCOMES),
    "reconcile_totals": " UNION ALL ".join(
        f"SELECT '{feed}' AS feed, outcome, CAST(SUM(rows) AS BIGINT) AS rows FROM ({_outcomes(parts)}) GROUP BY outcome"
        for feed, parts in (("production", _PRODUCTION_OUTCOMES), ("wells", _WELLS_OUTCOMES), ("flaring", _FLARING_OUTCOMES))
    ),
    "dropped_production": rounded("SELECT * FROM typed_production EXCEPT ALL SELECT * FROM silver_facts", "production"),
    "unchanged_production": rounded("SELECT * FROM typed_production INTERSECT ALL SELECT * FROM silver_facts", "production"),
    "broken_lines": """SELECT 'row' AS kind, concat_ws('|', squarerootsum, well_name, api_number) AS content FROM raw_wells
        UNION ALL SELECT 'broken', '1.5,short ' || s_suppkey FROM supplier
        UNION ALL SELECT 'broken', '2.5,long,' || s_suppkey || ',more' FROM supplier
        UNION ALL SELECT 'broken', '3.5,"open ' || s_suppkey || ',x' FROM supplier""",
    # joins over time
    "asof_metadata": rounded(
        """SELECT f.api_number, f.production_month, f.oil_and_gas_group, f.production, v.status, v.rate
           FROM production f ASOF LEFT JOIN (
               SELECT CAST(o_custkey AS VARCHAR) AS api_number, CAST(o_orderdate AS DATE) AS valid_from, o_orderpriority AS status, o_totalprice AS rate
               FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderpriority DESC, o_totalprice DESC) = 1) v
           ON f.api_number = v.api_number AND f.production_month >= v.valid_from""",
        "production rate",
    ),
    "enrich_production_asof": rounded(
        """SELECT f.api_number, COALESCE(f.well_name, v.well_name) AS well_name, operator, production_month,
                  CAST(year(production_month) AS INTEGER) AS production_year, 'Q' || CAST(quarter(production_month) AS VARCHAR) AS production_quarter,
                  oil_and_gas_group, production, shale_play, basin, v.rate AS well_length_ft
           FROM silver_facts f ASOF LEFT JOIN (
               SELECT CAST(o_custkey AS VARCHAR) AS api_number, CAST(o_orderdate AS DATE) AS valid_from, 'Well ' || o_orderpriority AS well_name, o_totalprice AS rate
               FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderpriority DESC, o_totalprice DESC) = 1) v
           ON f.api_number = v.api_number AND f.production_month >= v.valid_from""",
        "production well_length_ft",
    ),
    "ownership_overlap": rounded(
        """SELECT o.api_number, owned_from, owned_to, rate, reports_from, reports_to FROM (
               SELECT CAST(o_custkey AS VARCHAR) AS api_number, CAST(o_orderdate AS DATE) AS owned_from, MAX(o_totalprice) AS rate,
                      CAST(o_orderdate AS DATE) + CAST(floor(pow(MAX(o_totalprice) / 50000, 4)) AS INTEGER) AS owned_to
               FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)) o
           JOIN (SELECT api_number, MIN(production_month) AS reports_from, CAST(MAX(production_month) + INTERVAL 1 MONTH AS DATE) AS reports_to
                 FROM (SELECT api_number, production_month, year(production_month) * 12 + month(production_month)
                              - ROW_NUMBER() OVER (PARTITION BY api_number ORDER BY production_month) AS spell
                       FROM (SELECT DISTINCT api_number, production_month FROM production))
                 GROUP BY api_number, spell) s
           ON o.api_number = s.api_number AND owned_from < owned_to AND owned_from < reports_to AND reports_from < owned_to""",
        "rate",
    ),
    # windows over a stream: those that end before the last event less an hour
    "stream_tumbling": _closed(
        """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, INTERVAL 6 HOUR AS size, value FROM events"""
    ),
    "stream_sliding": _closed(
        """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * back) AS window_start, INTERVAL 24 HOUR AS size, value
           FROM events CROSS JOIN (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS back)"""
    ),
    "stream_sessions": rounded(
        """SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
                  strftime(MAX(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS window_end, COUNT(*) AS events, SUM(value) AS value
           FROM (SELECT *, SUM(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
                 FROM (SELECT *, COALESCE(ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM events))
           GROUP BY user_id, session
           HAVING MAX(ts) + INTERVAL 30 MINUTE <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)""",
        "value",
    ),
    # stages
    "stage_bronze": _counts(_BRONZE),
    "stage_silver": _counts(_SILVER),
    "stage_gold": _counts(_GOLD),
    "stage_forecast": _counts(_FORECAST_ROWS),
    "stage_counts": _counts({**_BRONZE, **_SILVER, **_GOLD, **_FORECAST_ROWS}),
}

# The report queries written as SQL text with the functions.
_TEXTS |= {
    "sql_operator_quarterly": _TEXTS["operator_quarterly"],
    "sql_avg_yoy_growth": _TEXTS["avg_yoy_growth"],
    "sql_top5_flaring_intensity": f"SELECT * EXCLUDE (flaring_rank) FROM ({_TEXTS['top5_flaring_intensity']})",
    "sql_forecast_slice": f"SELECT * EXCLUDE (entity_type, entity_id, forecast_start, qi, di, b_factor) FROM ({_TEXTS['forecast_slice']})",
    "sql_shares": rounded(
        f"""SELECT operator, production_year, shale_play,
                   CASE WHEN liquid_rich_production + dry_gas_production > 0
                        THEN liquid_rich_production / (liquid_rich_production + dry_gas_production) * 100 END AS liquid_pct,
                   CASE WHEN ethane_dry_gas_ratio > {ETHANE_THRESHOLD} THEN 'Liquid-Rich' ELSE 'Dry Gas' END AS basin_category,
                   CASE WHEN ethane_dry_gas_ratio > 0.3 THEN 'Liquid-Rich' ELSE 'Dry Gas' END AS default_category
            FROM ethane""",
        "liquid_pct",
    ),
}

# What the stages store: the same texts, over the cleaned feeds in place of the bound tables.
_CLEANED = {"production": "SELECT * FROM silver_production", "flaring": "SELECT * FROM silver_flaring"}
_FIRST = ["wells_of", *[name for name in CTES if name.startswith(("raw_", "typed_", "silver_")) and name != "raw_shale"]]
_STORED_CTES = {name: CTES[name] for name in _FIRST} | _CLEANED | {
    name: text for name, text in CTES.items() if name not in _FIRST and name not in _CLEANED and name != "raw_shale"
}
_STORED_TEXTS = {
    "stored_silver_wells": _TEXTS["clean_wells"],
    "stored_silver_flaring": _TEXTS["clean_flaring"],
    "stored_silver_production": _TEXTS["enrich_production"],
    "stored_gold_operator_performance": _TEXTS["operator_performance"],
    "stored_gold_basin_production_trends": _TEXTS["basin_production_trends"],
    "stored_gold_flaring_intensity": _TEXTS["flaring_intensity"],
    # the stage classes by its default threshold
    "stored_gold_ethane_dry_gas": rounded(
        """SELECT * REPLACE (CASE WHEN ethane_dry_gas_ratio > 0.3 THEN 'Liquid-Rich' ELSE 'Dry Gas' END AS basin_category)
           FROM ethane""",
        _ETHANE,
    ),
    "stored_gold_well_summary": _TEXTS["well_summary"],
    "stored_gold_production_forecast": """SELECT entity_type, entity_id, CAST(24 AS BIGINT) AS months,
        CAST(max(production_month) + INTERVAL 1 MONTH AS DATE) AS first_month,
        CAST(max(production_month) + INTERVAL 24 MONTH AS DATE) AS last_month
        FROM measured GROUP BY entity_type, entity_id""",
}
# The same tables again after two refreshes.
_STORED_TEXTS |= {
    f"refreshed_{name.removeprefix('stored_')}": text for name, text in _STORED_TEXTS.items() if "forecast" not in name
} | {
    "refreshed_gold_operator_performance": f"""SELECT * EXCLUDE (avg_monthly_production), CAST(round(total_oil_bbl / avg_monthly_production) AS BIGINT) AS oil_reports
        FROM ({_TEXTS['operator_performance']})""",
    "refreshed_years": "SELECT production_year, production_year IN (1997, 2001) AS rewritten FROM silver_production GROUP BY production_year"
}

ORACLES = {name: sql(text) for name, text in _TEXTS.items()} | {
    name: sql(text, _STORED_CTES) for name, text in _STORED_TEXTS.items()
}
