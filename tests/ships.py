"""Ten ships of a port-traffic case, EPSG:25832, 2024-03-15 UTC: instants that remain
after normalisation and the results expected from them."""

from datetime import datetime, timedelta

DAY = "2024-03-15 "

# Time, x, y of the instants.
SHIPS = {
    "maersk_essen": [("06:00", 585000, 5672000), ("07:30", 591000, 5678000), ("08:00", 592000, 5679000)],
    "cma_cgm_libra": [("06:00", 584000, 5671000), ("07:00", 586000, 5673000), ("08:00", 587000, 5674000), ("10:00", 587000, 5674000)],
    "msc_zoe": [("06:00", 585000, 5672000), ("10:00", 593000, 5680000)],
    "ever_given": [("05:00", 584500, 5671500), ("09:00", 592500, 5679500)],
    "stena_impero": [("08:00", 587500, 5674500), ("12:00", 587500, 5674500)],
    "european_trader": [("06:00", 575000, 5660000), ("10:00", 583000, 5668000)],
    "belgium_chem": [("05:00", 574000, 5659000), ("09:00", 582000, 5667000)],
    "antwerp_star": [("07:00", 595000, 5680000), ("11:00", 587000, 5672000)],
    "schelde_river": [("06:30", 578000, 5663000), ("10:30", 586000, 5671000)],
    "diamond_express": [("08:30", 596000, 5681000), ("12:30", 588000, 5673000)],
}
PORT = (584000, 5670000, 593000, 5680000)
IN_PORT = set(SHIPS) - {"european_trader", "belgium_chem"}
MORNING = (DAY + "10:30:00", DAY + "11:30:00")
IN_MORNING = {"stena_impero", "antwerp_star", "schelde_river", "diamond_express"}


def at(clock: str) -> datetime:
    return datetime.fromisoformat(DAY + clock)


def raw_rows() -> list[tuple]:
    """The ships with every half hour filled in between the instants."""
    rows = []
    for name, points in SHIPS.items():
        for (c1, x1, y1), (c2, x2, y2) in zip(points, points[1:]):
            t1, t2 = at(c1), at(c2)
            n = int((t2 - t1) / timedelta(minutes=30))
            rows += [
                (name, t1 + timedelta(minutes=30 * i), x1 + (x2 - x1) * i / n, y1 + (y2 - y1) * i / n)
                for i in range(n)
            ]
        last = points[-1]
        rows.append((name, at(last[0]), float(last[1]), float(last[2])))
    return rows


def instants(spark):
    return spark.createDataFrame(raw_rows(), "geom_id string, t timestamp, x double, y double")


def clock(t: datetime) -> str:
    return t.strftime("%H:%M")
