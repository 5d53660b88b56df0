"""Column-level helpers. Everything here returns a ``pyspark.sql.Column`` and
stays inside whole-stage codegen (no Python UDFs)."""

from tillstar.functions.money import MONEY, dec, money  # noqa: F401
from tillstar.functions.dates import date_attributes, date_key  # noqa: F401
from tillstar.functions.coerce import (  # noqa: F401
    clean_text, non_negative, parse_date, parse_number, strip_store_prefix,
)
