"""Column functions on JSON objects in text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The attribute that keeps a text that is no JSON object.
UNPARSED = "_unparsed"
MEMBERS = "array<struct<key:string,text:string,kind:string>>"


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(text), {"writeNonAsciiCharacterAsCodePoint": str(ascii_only).lower()}), r"^\[|\]$", "")


def json_members(text: Column) -> Column:
    """The members of a JSON object in their order, repeated names included: array of (key, text, kind).

    kind is text, with the text itself, or nested or plain, with the value in JSON; numbers keep being what they are, 1.0 stays 1.0. A text
    that is no object becomes one member ``_unparsed`` with the text, so nothing is lost; null gives null.
    """
    values = F.map_entries(F.from_json(text, "map<string,string>"))
    kinds = F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: F.schema_of_variant(e["value"]))
    nested, plain = lambda v: v.rlike(r"(?s)^[\[{].*[\]}]$"), lambda v: v.rlike(r"^(true|false|-?\d.*)$")

    def member(e: Column, i: Column) -> Column:
        is_text = F.coalesce(F.get(kinds, i) == "STRING", ~nested(e["value"]) & ~plain(e["value"]))  # an object that repeats names has no variant
        kind = F.when(e["value"].isNull(), "plain").when(is_text, "text").when(nested(e["value"]), "nested").otherwise("plain")
        return F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("null")).alias("text"), kind.alias("kind"))

    whole = F.array(F.struct(F.lit(UNPARSED).alias("key"), text.alias("text"), F.lit("text").alias("kind")))
    return F.when(text.isNotNull(), F.coalesce(F.transform(values, member), whole))


def member(key: str | Column, text: Column, kind: str = "text") -> Column:
    """One member, of a key and a value that isn't null."""
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), text.alias("text"), F.lit(kind).alias("kind"))


def joined(*parts: Column) -> Column:
    """Arrays of members as one; of members of one name the last value counts, at the first place."""
    whole = F.concat(*parts)
    first = F.filter(whole, lambda x, i: (i == 0) | ~F.exists(F.slice(whole, 1, F.greatest(i, F.lit(1))), lambda y: y["key"] == x["key"]))
    last = lambda x: F.element_at(F.filter(whole, lambda y: y["key"] == x["key"]), -1)
    return F.transform(first, last)


def value_text(x: Column, ascii_only: bool = False) -> Column:
    """A member's value in JSON."""
    return F.when(x["kind"] == "text", json_string(x["text"], ascii_only)).otherwise(x["text"])


def json_entries(text: Column) -> Column:
    """As :func:`json_members`: array of (key, value), value in JSON."""
    return F.transform(json_members(text), lambda x: F.struct(x["key"].alias("key"), value_text(x).alias("value")))
