"""Fixed schemas; nothing is inferred at read time."""

from __future__ import annotations

AIS_REPORT = """
    T timestamp, TypeOfMobile string, MMSI int, Latitude double, Longitude double,
    NavigationalStatus string, ROT double, SOG double, COG double, Heading int,
    IMO string, Callsign string, Name string, ShipType string, CargoType string,
    Width double, Length double, TypeOfPositionFixingDevice string, Draught double,
    Destination string, ETA string, DataSourceType string,
    SizeA double, SizeB double, SizeC double, SizeD double
"""

COLLECTIONS = """
    id string, title string, description string, update_frequency int, item_type string,
    created_at timestamp, updated_at timestamp
"""

FEATURES = """
    feature_id string, collection_id string, type string, properties string, crs string,
    trs string, srid int, xmin double, ymin double, xmax double, ymax double,
    tmin timestamp, tmax timestamp, created_at timestamp
"""

GEOMETRIES = """
    geom_id long, feature_id string, collection_id string, geometry_type string, srid int,
    interpolation string, xmin double, ymin double, xmax double, ymax double,
    tmin timestamp, tmax timestamp, n_instants long, base string, created_at timestamp
"""

INSTANTS = "geom_id long, feature_id string, collection_id string, t timestamp, x double, y double"

PROPERTIES = """
    property_id long, feature_id string, property_name string, property_type string,
    form string, description string, created_at timestamp
"""

TEMPORAL_VALUES = """
    value_id long, property_id long, datetimes array<timestamp>, values array<string>,
    interpolation string, created_at timestamp
"""

TABLES = {
    "collections": COLLECTIONS,
    "features": FEATURES,
    "geometries": GEOMETRIES,
    "instants": INSTANTS,
    "properties": PROPERTIES,
    "temporal_values": TEMPORAL_VALUES,
}

# JSON documents. A field that may be an object or text is read as text.
FEATURE_DOCUMENT = """
    type string, id string, properties string, bbox array<double>, time array<string>,
    crs struct<type: string, properties: string>, trs string,
    temporalGeometry string, temporalProperties string
"""
TRAJECTORY_DOCUMENT = """
    type string, datetimes array<string>, coordinates array<array<double>>,
    interpolation string, base string
"""
PROPERTY_MEMBER = """
    type string, form string, values array<string>, interpolation string, description string
"""
COLLECTION_DOCUMENT = "title string, description string, updateFrequency int, itemType string"
PROPERTY_DOCUMENT = "name string, type string, form string, description string"
VALUES_DOCUMENT = "datetimes array<string>, values array<string>, interpolation string"
