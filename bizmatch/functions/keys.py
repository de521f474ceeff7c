"""Blocking keys: one array expression, whose order breaks ties between candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import significant_words, tokens

#: Characters of the name prefixes; longest name that is a key as a whole; least digits of a number key.
LONG_PREFIX, SHORT_PREFIX, EXACT_MOST, NUMBER_LEAST = 4, 3, 25, 4
NAME_WORD, ADDRESS_WORD = 3, 4


def address_words(address: Column | str) -> Column:
    """The words of an address that keys are made of: a column of its own where addresses are long, as keys read it six times."""
    return F.slice(significant_words(address, ADDRESS_WORD), 1, 2)


def blocking_keys(name: Column | str, address: Column | str, numbers: Column | str, places: Column | None = None) -> Column:
    """The tagged keys of a record as an array, in order, repeated numbers repeated. places: what address_words made of the address."""
    name, address, numbers = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (name, address, numbers))
    size = F.length(name)
    words, digits = significant_words(name, NAME_WORD), tokens(numbers)
    places = address_words(address) if places is None else places
    tag = lambda label, when, value: F.when(when, F.concat(F.lit(label + ":"), value))
    short, head, place = F.substring(name, 1, SHORT_PREFIX), F.get(digits, F.lit(0)), F.get(places, F.lit(0))
    first = F.array(
        tag("p4", size >= LONG_PREFIX, F.substring(name, 1, LONG_PREFIX)),
        tag("p3", size >= SHORT_PREFIX, short),
        tag("exact", size.between(SHORT_PREFIX, EXACT_MOST), name),
        tag("w1", F.size(words) >= 1, F.get(words, F.lit(0))),
        tag("w2", F.size(words) >= 2, F.get(words, F.lit(1))),
        tag("wlast", F.size(words) >= 3, F.get(words, F.size(words) - 1)),
    )
    long_numbers = F.transform(F.filter(digits, lambda n: F.length(n) >= NUMBER_LEAST), lambda n: F.concat(F.lit("num:"), n))
    last = F.array(
        tag("num_w", head.isNotNull() & place.isNotNull(), F.concat(head, F.lit("_"), place)),
        tag("num_p3", head.isNotNull() & (size >= SHORT_PREFIX), F.concat(head, F.lit("_"), short)),
        tag("aw1", place.isNotNull(), place),
        tag("aw2", F.size(places) >= 2, F.get(places, F.lit(1))),
    )
    return F.filter(F.concat(first, long_numbers, last), lambda k: k.isNotNull())
