"""Column expressions over tokens: up to four fields, separated by ``/``.

Two rules for the fifth field on are kept apart: a *pattern* keeps the remainder in the
fourth field, a *label* drops it. Empty fields are fields.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colligate.errors import OptionError

#: The fields of a pattern where none are chosen: all but the surface form.
DEFAULT_FIELDS = (2, 3, 4)
SURFACE_FIELDS = (1, 2, 3, 4)


def parse_fields(text: str) -> tuple[int, ...]:
    """A selection such as ``2,3``, ``23`` or ``2f/4f`` as sorted field numbers."""
    if not text or re.fullmatch(r"(?:[1-4][fF]?|[,./:+\-_ \t])*", text) is None:
        raise OptionError(f"not a selection of fields 1 to 4: {text!r}")
    found = tuple(sorted(set(map(int, re.findall("[1-4]", text)))))
    if not found:
        raise OptionError(f"no field is selected: {text!r}")
    return found


def fields(token: Column) -> Column:
    """The fields of a pattern; the fourth keeps what follows."""
    return F.split(token, "/", 4)


def label_fields(token: Column) -> Column:
    """The fields of a label; what follows the fourth is dropped."""
    return F.slice(F.split(token, "/"), 1, 4)


def field(token: Column, n: int) -> Column:
    """Field ``n``, null if there is none."""
    return F.get(fields(token), F.lit(n - 1))


def field_equals(token: Column, n: int, value: str) -> Column:
    """Whether field ``n`` is there and equals ``value``."""
    return F.coalesce(field(token, n) == value, F.lit(False))


def project(token: Column, chosen: Sequence[int] = DEFAULT_FIELDS) -> Column:
    """The chosen fields that exist, in their order; the whole token if none does."""
    return projected(fields(token), token, chosen)


def projected(parts: Column, token: Column, chosen: Sequence[int] = DEFAULT_FIELDS) -> Column:
    """The same of a token whose ``fields`` are there already."""
    wanted = F.array_compact(F.array(*(F.get(parts, F.lit(n - 1)) for n in sorted(set(chosen)))))
    return F.when(F.size(parts) < min(chosen), token).otherwise(F.array_join(wanted, "/"))


def label(token: Column, chosen: Sequence[int] = (1,), separator: str = "/") -> Column:
    """The chosen fields that exist, in the order given; the whole token if none does."""
    parts = label_fields(token)
    wanted = F.array_compact(F.array(*(F.get(parts, F.lit(n - 1)) for n in dict.fromkeys(chosen))))
    return F.when(F.size(wanted) == 0, token).otherwise(F.array_join(wanted, separator))
