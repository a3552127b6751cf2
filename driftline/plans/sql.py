"""Common table expressions of the check SQL, in the dialect of the checking engine.

They restate the views of ``driver_tables`` and the published definitions.
"""

from __future__ import annotations

from driftline.functions import projection as _p

KIND_CODE = ("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
             "WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END")


def _bend(f: str, p: str, n: str) -> str:
    share = "((epoch_us(t)-epoch_us(pt))/1e6)/nullif((epoch_us(nt)-epoch_us(pt))/1e6, 0)"
    return f"abs({p} + ({n}-{p})*({share}) - {f}) > greatest(1e-9, abs({f})*1e-12)"


def turn(f: str) -> str:
    """Instants that normalisation keeps, for one value with ``px``/``nx`` beside it."""
    return f"(pt IS NULL OR nt IS NULL OR {_bend(f, 'px', 'nx')})"


TURN = f"(pt IS NULL OR nt IS NULL OR {_bend('x', 'px', 'nx')} OR {_bend('y', 'py', 'ny')})"


def hit(x1: str, y1: str, x2: str, y2: str) -> str:
    """The segment (x,y)-(nx,ny) of ``seq`` meets the box; the last instant is a point."""
    dx, dy = "(coalesce(nx,x)-x)", "(coalesce(ny,y)-y)"

    def bounds(low: str, high: str, p: str, d: str) -> tuple[str, str]:
        a, b = f"({low}-{p})/nullif({d},0)", f"({high}-{p})/nullif({d},0)"
        return f"least({a},{b})", f"greatest({a},{b})"

    ex, lx = bounds(x1, x2, "x", dx)
    ey, ly = bounds(y1, y2, "y", dy)
    return (f"(greatest(0.0,{ex},{ey}) <= least(1.0,{lx},{ly}) AND ({dx} <> 0 OR x BETWEEN {x1} AND {x2}) "
            f"AND ({dy} <> 0 OR y BETWEEN {y1} AND {y2}))")


def _sum(coefficients, a: str, f: str, b: str = "", g: str = "") -> str:
    terms = []
    for j, c in enumerate(coefficients, start=1):
        second = f"*{g}({2.0 * j}*{b})" if g else ""
        terms.append(f"{c!r}*{f}({2.0 * j}*{a}){second}")
    return "(" + " + ".join(terms) + ")"


def utm32(source: str) -> str:
    """``source`` with columns ``east, north`` from ``lon, lat``."""
    s, d = "sin(radians(lat))", f"radians(lon-{_p.CENTRAL_MERIDIAN})"
    north = f"{_p.RECTIFYING!r}*(xi + {_sum(_p.FORWARD, 'xi', 'sin', 'eta', 'cosh')})"
    east = f"{_p.FALSE_EASTING} + {_p.RECTIFYING!r}*(eta + {_sum(_p.FORWARD, 'xi', 'cos', 'eta', 'sinh')})"
    return f"""SELECT *, {east} AS east, {north} AS north FROM (
        SELECT *, atan2(ct, cos({d})) AS xi, atanh(sin({d})/sqrt(1+ct*ct)) AS eta FROM (
        SELECT *, sinh(atanh({s}) - {_p.ECCENTRICITY!r}*atanh({_p.ECCENTRICITY!r}*{s})) AS ct FROM {source}))"""


def wgs84(source: str) -> str:
    """``source`` with columns ``lon, lat`` from ``e, n``."""
    return f"""SELECT *, {_p.CENTRAL_MERIDIAN} + degrees(atan2(sinh(eta1), cos(xi1))) AS lon,
        degrees(chi + {_sum(_p.LATITUDE, 'chi', 'sin')}) AS lat FROM (
        SELECT *, asin(sin(xi1)/cosh(eta1)) AS chi FROM (
        SELECT *, xi - {_sum(_p.INVERSE, 'xi', 'sin', 'eta', 'cosh')} AS xi1,
            eta - {_sum(_p.INVERSE, 'xi', 'cos', 'eta', 'sinh')} AS eta1 FROM (
        SELECT *, n/{_p.RECTIFYING!r} AS xi, (e-{_p.FALSE_EASTING})/{_p.RECTIFYING!r} AS eta FROM {source} s)))"""


REPORT_COLUMNS = ("t", "mmsi", "lat", "lon", "sog", "cog", "heading", "navigational_status", "imo", "callsign",
                  "name", "ship_type", "cargo_type", "destination", "type_of_position_fixing_device",
                  "type_of_mobile", "length", "width", "draught")


def dedup(source: str, name: str) -> str:
    """Keep the least report of each (mmsi, t), NULL first."""
    order = ", ".join(f"{c} NULLS FIRST" for c in REPORT_COLUMNS if c not in ("t", "mmsi"))
    return f""", {name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
        (PARTITION BY mmsi, t ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"""


CTE = {
    "tracks": f"""tracks AS (SELECT event_id, user_id AS feature_id, user_id * 10 + {KIND_CODE} AS geom_id, event_type,
        ts AS t, value AS x, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS y FROM events)""",
    "seq": """seq AS (SELECT geom_id, t, x, y, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py,
        lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tracks
        WINDOW w AS (PARTITION BY geom_id ORDER BY t))""",
    "norm": f"""norm AS (SELECT geom_id, t, x, y FROM seq WHERE {TURN})""",
    "mixed": f"""kinds AS (SELECT geom_id, any_value(CASE event_type WHEN 'signup' THEN 'Discrete' WHEN 'view' THEN 'Step' ELSE 'Linear' END) AS kind
        FROM tracks GROUP BY geom_id),
    mixed AS (SELECT geom_id, kind, t, x, y FROM seq JOIN kinds USING (geom_id) WHERE CASE kind WHEN 'Discrete' THEN true
        WHEN 'Step' THEN pt IS NULL OR nt IS NULL OR px <> x OR py <> y ELSE {TURN} END)""",
    "speed": """legs AS (SELECT geom_id, t, lag(t) OVER w AS pt, lead(t) OVER w AS nt,
        round(sqrt((lead(x) OVER w - x)*(lead(x) OVER w - x) + (lead(y) OVER w - y)*(lead(y) OVER w - y))
            / ((epoch_us(lead(t) OVER w) - epoch_us(t)) / 1e6), 9) AS v
        FROM norm WINDOW w AS (PARTITION BY geom_id ORDER BY t)),
    levels AS (SELECT geom_id, t, pt, nt, coalesce(v, lag(v) OVER (PARTITION BY geom_id ORDER BY t)) AS speed
        FROM legs WHERE pt IS NOT NULL OR nt IS NOT NULL),
    speed AS (SELECT geom_id, t, speed FROM (SELECT *, lag(speed) OVER (PARTITION BY geom_id ORDER BY t) AS before
        FROM levels) WHERE pt IS NULL OR nt IS NULL OR before <> speed)""",
    "boxes": """boxes AS (SELECT geom_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
        min(t) AS tmin, max(t) AS tmax, count(*) AS n_instants FROM tracks GROUP BY geom_id)""",
    "features": """features AS (SELECT c_custkey AS feature_id, replace(lower(n_name), ' ', '_') AS collection_id,
        c_name AS name, TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 1 MINUTE AS created_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "requests": """requests AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'F'
            THEN replace(lower(o_orderpriority), ' ', '_') WHEN 'P' THEN 'nation_' || ((c_nationkey + 1) % 25)
            ELSE replace(lower(n_name), ' ', '_') END AS collection_id, o_custkey AS feature_id,
        o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS geom_id,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'click' WHEN '2' THEN 'error' WHEN '3' THEN 'purchase'
            WHEN '4' THEN 'signup' ELSE 'view' END AS property_name,
        day(o_orderdate) AS day, o_orderpriority AS priority, o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "regions": """regions AS (SELECT s_suppkey AS region_id, least(x, x + s) AS xmin, least(y, y + s) AS ymin,
        greatest(x, x + s) AS xmax, greatest(y, y + s) AS ymax FROM (SELECT s_suppkey, s_suppkey % 100 * 4.0::DOUBLE AS x,
        s_nationkey * 4.0::DOUBLE AS y, s_acctbal / 1000 AS s FROM supplier))""",
    "batches": """batches AS (SELECT min(event_id) AS value_id, geom_id AS property_id, day(t) AS day,
        count(*)::INTEGER AS n_values, min(t) AS first_time, max(t) AS final_time FROM tracks
        GROUP BY geom_id, date_trunc('day', t), day(t))""",
    "reports": """reports AS (SELECT date_trunc('hour', t) AS t, feature_id AS mmsi, 54.0::DOUBLE + y / 50 AS lat,
        4.0::DOUBLE + x / 15 AS lon, CASE WHEN y <> 0 THEN y / 4 END AS sog, x AS cog,
        CASE WHEN y < 90 THEN y * 3 END AS heading,
        CASE event_type WHEN 'signup' THEN 'Undefined' WHEN 'error' THEN 'Unknown value' ELSE event_type END AS navigational_status,
        CASE event_type WHEN 'error' THEN 'Unknown' ELSE 'IMO' || feature_id END AS imo,
        CASE event_type WHEN 'view' THEN 'Unknown' ELSE 'C' || feature_id || event_type END AS callsign,
        CASE event_type WHEN 'error' THEN 'Unknown' WHEN 'click' THEN '' ELSE 'Ship ' || feature_id || event_type END AS name,
        CASE event_type WHEN 'signup' THEN 'Undefined' ELSE event_type END AS ship_type,
        CASE event_type WHEN 'purchase' THEN 'Undefined' ELSE 'Cargo ' || event_type END AS cargo_type,
        CASE event_type WHEN 'view' THEN 'Unknown' WHEN 'signup' THEN 'Undefined' WHEN 'error' THEN NULL
            ELSE 'Port ' || CAST(y AS INTEGER) END AS destination,
        CASE event_type WHEN 'click' THEN 'Undefined' ELSE 'GPS' END AS type_of_position_fixing_device,
        'Class A' AS type_of_mobile, y * 2 AS length, y / 2 AS width, x / 50 AS draught FROM tracks)""",
    "cleaned": """cleaned AS (SELECT * REPLACE (
        CASE WHEN navigational_status IN ('Unknown value', 'Undefined') THEN NULL ELSE navigational_status END AS navigational_status,
        nullif(imo, 'Unknown') AS imo, nullif(ship_type, 'Undefined') AS ship_type,
        nullif(cargo_type, 'Undefined') AS cargo_type,
        nullif(type_of_position_fixing_device, 'Undefined') AS type_of_position_fixing_device,
        CASE WHEN destination IN ('Unknown', 'Undefined') THEN NULL ELSE destination END AS destination,
        nullif(name, 'Unknown') AS name, nullif(callsign, 'Unknown') AS callsign) FROM reports)""",
    "inside": """inside AS (SELECT * FROM cleaned WHERE lat BETWEEN 40.18 AND 84.73 AND lon BETWEEN -16.1 AND 32.88
        AND sog IS NOT NULL AND cog IS NOT NULL)""",
    "dedup": dedup("inside", "dedup").removeprefix(", "),
    "positions": f"""positions AS (SELECT * EXCLUDE (ct, xi, eta, east, north), east AS x, north AS y FROM ({utm32('dedup')}))""",
    "moves": """moves AS (SELECT mmsi, coalesce(sum(len), 0) AS length,
        abs(coalesce(sum((sog + ns) / 2 * dt) / nullif(sum(dt), 0), min(sog)) * 1.852
            - sum(len) / nullif(sum(dt), 0) * 3.6) AS gap
        FROM (SELECT mmsi, sog, lead(sog) OVER w AS ns, (epoch_us(lead(t) OVER w) - epoch_us(t)) / 1e6 AS dt,
            sqrt((lead(x) OVER w - x)*(lead(x) OVER w - x) + (lead(y) OVER w - y)*(lead(y) OVER w - y)) AS len
            FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY t)) GROUP BY mmsi)""",
}
NEEDS = {"norm": ("seq",), "mixed": ("seq",), "speed": ("seq", "norm")}


def ctes(*names: str) -> str:
    """``WITH`` clause of the named expressions and what they need, in order."""
    wanted = set(names)
    for name in names:
        wanted.update(NEEDS.get(name, ()))
    return "WITH " + ",\n".join(text for name, text in CTE.items() if name in wanted) + "\n"
