"""The two text forms that are embedded."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.functions.text import strip


def _field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_repr() -> Column:
    """``name | type | description`` without the empty parts."""
    parts = [
        F.nullif(strip(_field(c)), F.lit(""))
        for c in ("BuildingName", "Type", "WODescription")
    ]
    return F.concat_ws(" | ", *parts)


def _value(name: str) -> Column:
    v = F.lower(strip(_field(name)))
    return F.when(
        v.isin("", "nan", "none", "unknown_building", "unknown_type"), F.lit("unknown")
    ).otherwise(v)


def mice_repr(separator: str = " ") -> Column:
    """Labelled sentences over all fields; a placeholder reads ``unknown``."""
    sentences = [
        F.concat(F.lit("building id: "), _value("BuildingID"), F.lit(".")),
        F.concat(F.lit("building name: "), _value("BuildingName"), F.lit(".")),
        F.concat(F.lit("facility type: "), _value("Type"), F.lit(".")),
        F.concat(F.lit("equipment system: "), _value("equipment"), F.lit(".")),
        F.concat(
            F.lit("work period: "), _value("WOStartDate"),
            F.lit(" to "), _value("WOEndDate"), F.lit("."),
        ),
        F.concat(F.lit("work order description: "), _value("WODescription"), F.lit(".")),
    ]
    return F.concat_ws(separator, *sentences)


def with_representations(df: DataFrame) -> DataFrame:
    return df.withColumns({"text_repr": text_repr(), "mice_repr": mice_repr()})


def preview_text() -> Column:
    """Short label of a work order: id, equipment, type and 80 characters of text."""
    return F.concat(
        _field("WOID"), F.lit("\nEquipment: "), _field("equipment"),
        F.lit("\nType: "), _field("Type"), F.lit("\n"),
        F.substring(_field("WODescription"), 1, 80), F.lit("…"),
    )
