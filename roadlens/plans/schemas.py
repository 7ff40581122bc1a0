"""The domain tables' schemas, with the limits that were declared for their columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names.split(), kind)


def _struct(fields: dict[str, T.DataType], required: str = "") -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required.split()) for n, t in fields.items()])


TEXT, INT, DAY, STAMP = T.StringType(), T.IntegerType(), T.DateType(), T.TimestampNTZType()

#: Columns of a death record by kind: those that a file holds, in no particular order.
DEATH_DATES = tuple("dtobito dtnasc dtinvestig dtcadastro dtrecebim".split())
DEATH_INTS = tuple("contador codmunnatu idade codmunres codmunocor".split())
#: Text columns with the length that the store allows.
DEATH_TEXT_LIMITS = {
    **dict.fromkeys("tipobito sexo racacor estciv esc esc2010 lococor circobito acidtrab fonte origem assistmed exame cirurgia necropsia tppos atestante stcodifica codificado".split(), 1),
    "horaobito": 10, "natural": 3, "seriescfal": 2, "ocup": 6, "codestab": 7, "numerolote": 20, "versaosist": 10, "versaoscb": 10,
}
DEATH_TEXTS = tuple("estabdescr linhaa linhab linhac linhad linhaii causabas causabas_o cb_pre".split())
#: Date and number columns that files hold beside the schema; they are converted but not kept.
EXTRA_DATES = tuple("dtatestado dtrecoriga dtcadinv dtconinv dtconcaso".split())
EXTRA_INTS = tuple("idademae qtdfilvivo qtdfilmort semagestac peso nudiasobco nudiasobin nudiasinf".split())

TRAFFIC_DEATHS = _struct(
    {
        "id": INT,
        **dict.fromkeys(DEATH_INTS, INT),
        **dict.fromkeys(DEATH_DATES, DAY),
        **dict.fromkeys(DEATH_TEXT_LIMITS, TEXT),
        **dict.fromkeys(DEATH_TEXTS, TEXT),
        "data_year": INT,
        "import_batch": TEXT,
        "created_at": STAMP,
        "updated_at": STAMP,
    },
    "id dtobito causabas created_at updated_at",
)

COUNTING_LOCATIONS = _struct(
    {
        "id": INT, **_fields(TEXT, "name city state"),
        "latitude": T.DecimalType(10, 7), "longitude": T.DecimalType(10, 7), "metadata": TEXT, "created_at": STAMP, "updated_at": STAMP,
    },
    "id name city state latitude longitude",
)
COUNTING_EVENTS = _struct(
    {
        "id": INT, "location_id": INT, "counting_date": DAY, **_fields(TEXT, "start_time end_time"),
        **_fields(INT, "total_cyclists max_hour_cyclists"), **_fields(TEXT, "weather_conditions notes"), "created_at": STAMP, "updated_at": STAMP,
    },
    "id location_id counting_date start_time end_time",
)
COUNTING_SESSIONS = _struct(
    {
        "id": INT, "event_id": INT, "session_label": TEXT, "start_time": STAMP, "end_time": STAMP,
        "total_cyclists": INT, "characteristics": TEXT, "created_at": STAMP, "updated_at": STAMP,
    },
    "id event_id session_label start_time end_time",
)
SESSION_MOVEMENTS = _struct({"id": INT, "session_id": INT, **_fields(TEXT, "from_direction to_direction"), "count": INT, "created_at": STAMP}, "id session_id from_direction to_direction")
CYCLIST_PROFILES = _struct({"id": INT, "data": TEXT, "metadata": TEXT, "created_at": STAMP, "updated_at": STAMP}, "id data metadata")

TABLES = {
    "traffic_deaths": TRAFFIC_DEATHS,
    "counting_locations": COUNTING_LOCATIONS,
    "counting_events": COUNTING_EVENTS,
    "counting_sessions": COUNTING_SESSIONS,
    "session_movements": SESSION_MOVEMENTS,
    "cyclist_profiles": CYCLIST_PROFILES,
}

#: Domains. Fixed values, as recorded.
DIRECTIONS = ("north", "east", "south", "west")
CHARACTERISTICS = (
    "cargo", "helmet", "juveniles", "motor", "other_active_modes", "other_behaviors", "others",
    "rain", "ride", "service", "shared_bike", "sidewalk", "women", "wrong_way",
)
CODED = {
    "tipobito": "12", "sexo": "012", "racacor": "123459", "lococor": "123459", "circobito": "12349", "acidtrab": "129",
}

#: Shapes of the JSON documents.
CHARACTERISTICS_SHAPE = _struct(dict.fromkeys(CHARACTERISTICS, INT))
WEATHER_SHAPE = _struct({**_fields(T.DoubleType(), "temperature humidity precipitation wind_speed"), "conditions": TEXT})
DIRECTIONS_SHAPE = _struct(dict.fromkeys(DIRECTIONS, TEXT))
LOCATION_METADATA_SHAPE = _struct({"ibge_city_id": INT, "state_full": TEXT, "is_rmr": T.BooleanType(), "directions": DIRECTIONS_SHAPE, "notes": TEXT})

#: A document of the counts file.
MOVEMENT_KEYS = tuple(f"{a}_{b}" for a in DIRECTIONS for b in DIRECTIONS if a != b)
SESSION_DOCUMENT = _struct(
    {
        "session": TEXT, "start_time": TEXT, "end_time": TEXT, "total_cyclists": INT,
        "quantitative": _struct(dict.fromkeys(MOVEMENT_KEYS, INT)), "characteristics": CHARACTERISTICS_SHAPE,
    }
)
COUNT_DOCUMENT = _struct(
    {
        "id": INT,
        "coordinates": _struct({"x": T.DoubleType(), "y": T.DoubleType()}),
        "metadata": _struct(
            {
                "name": TEXT, "date": TEXT,
                "city": _struct({"id": INT, "name": TEXT, "state": TEXT, "full_state": TEXT, "rmr": T.BooleanType()}),
                "directions": DIRECTIONS_SHAPE,
            }
        ),
        "data": _struct({"sessions": T.ArrayType(SESSION_DOCUMENT)}),
    }
)


def ddl(table: str, path: str | None = None) -> str:
    """The statement that creates a table; deaths are laid out by year, so that a year's query reads a year."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in TABLES[table].fields)
    layout = " PARTITIONED BY (data_year)" if table == "traffic_deaths" else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{layout}" + (f" LOCATION '{path}'" if path else "")
