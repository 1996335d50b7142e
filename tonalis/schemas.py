"""Fixed schemas of the data model; every operator takes and returns these layouts."""

SIGNAL = "track_id string, n long, x double"
FRAMES = "track_id string, n long, k int, v double"
SPECTRUM = "track_id string, n long, k int, re double, im double"
NOTES = "track_id string, start double, duration double, pitch double, velocity double, label string"
SEGMENTS = "track_id string, start double, end double, label string"
POSITIONS = "track_id string, pos double, label string"
CELLS = "pair_id string, n long, m long, v double"
PATH = "pair_id string, idx int, n long, m long"
PEAKS = "track_id string, n long, k int"


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def check(df, schema: str):
    """Fail early if a layout's columns are missing."""
    missing = [c for c in names(schema) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; the layout is: {schema}")
    return df
