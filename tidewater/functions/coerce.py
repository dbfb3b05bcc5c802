"""JSON values to the text that is indexed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(doc: Column, name: str, kind: str) -> Column:
    path = "$['" + name.replace("'", "\\'") + "']"
    return F.try_variant_get(doc, path, kind)


def json_text(doc: Column, name: str) -> Column:
    """A string as it is, a number with six decimals, a boolean as true or false; null, arrays, objects and what isn't there are null."""
    kind = F.schema_of_variant(_at(doc, name, "variant"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "STRING", _at(doc, name, "string")).when(number, F.format_string("%.6f", _at(doc, name, "double"))).when(kind == "BOOLEAN", F.lower(_at(doc, name, "string")))


def json_string(doc: Column, name: str) -> Column:
    return F.when(F.schema_of_variant(_at(doc, name, "variant")) == "STRING", _at(doc, name, "string"))


def json_weights(doc: Column, name: str) -> Column:
    """The numbers of an array; anything else in it is passed over, and anything but an array is null."""
    items = _at(doc, name, "array<variant>")
    numbers = F.transform(items, lambda x: F.try_variant_get(x, "$", "float"))
    return F.filter(numbers, lambda x: x.isNotNull())


def json_number(doc: Column, name: str) -> Column:
    kind = F.schema_of_variant(_at(doc, name, "variant"))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), _at(doc, name, "float"))
