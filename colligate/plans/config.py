"""The configuration of graphs and tables, with its defaults and its rules."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from colligate.errors import OptionError

# Names that a configuration may use.
FORMATS = {"json": "json", "dot": "dot", "d3": "d3", "md": "md", "markdown": "md", "tex": "tex", "latex": "tex", "html": "html"}
EDGE_LABELS = ("none", "ctf", "cdf", "cw", "z")
TOOLTIPS = ("ctf", "cdf", "cw", "z", "unit_ids")
SIZES = ("fq", "idf", "degree")
TABLE_COLUMNS = ("token1", "token2", "raw_token1", "raw_token2", "ctf", "cdf", "df1", "idf1", "fq1", "df2", "idf2", "fq2", "cw", "z", "unit_ids")


@dataclass(frozen=True)
class Config:
    path: str = ""
    format: str = "dot"
    min_cw: float | None = None
    min_z: float | None = None
    graph_name: str = "G"
    directed: bool = False
    charset: str | None = "UTF-8"
    overlap: bool = False
    outputorder: str | None = "edgesfirst"
    graph_fontname: str | None = None
    sep: str | None = None
    pack: bool | None = None
    packmode: str | None = None
    splines: str | None = None
    node_shape: str | None = "plaintext"
    node_fontname: str | None = None
    label_fields: tuple[int, ...] = (1,)
    label_separator: str = "/"
    font_size_by: str = "fq"
    min_font_size: float = 7.0
    max_font_size: float = 32.0
    edge_label: str = "ctf"
    tooltip: tuple[str, ...] = TOOLTIPS
    penwidth: float = 1.0
    edge_length: float | None = None
    edge_fontname: str | None = None
    columns: tuple[str, ...] = ("token1", "token2", "ctf", "cdf", "cw", "z", "unit_ids")
    headers: tuple[str, ...] = ()
    table_label_fields: tuple[int, ...] = (1,)
    table_label_separator: str = "/"
    precision: int = 6
    unit_separator: str = ", "
    caption: str | None = None
    table_label: str | None = None

    def __post_init__(self) -> None:
        if self.max_font_size < self.min_font_size:
            raise OptionError("max_font_size is less than min_font_size")
        if len(self.headers) > len(self.columns):
            raise OptionError("there are more headers than columns")


def output_format(name: str) -> str:
    return _one_of(name, FORMATS, "format") and FORMATS[name]


def _one_of(value: Any, names: Any, what: str) -> Any:
    if not isinstance(value, str) or value not in names:
        raise OptionError(f"{what}: not one of {', '.join(names)}: {value!r}")
    return value


def _string(value: Any, what: str) -> str:
    if not isinstance(value, str):
        raise OptionError(f"{what}: not a string")
    return value


def _bool(value: Any, what: str) -> bool:
    if not isinstance(value, bool):
        raise OptionError(f"{what}: not true or false")
    return value


def _number(value: Any, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise OptionError(f"{what}: not a number")
    return float(value)


def _positive(value: Any, what: str) -> float:
    if _number(value, what) <= 0:
        raise OptionError(f"{what}: not positive")
    return float(value)


def _fields(value: Any, what: str) -> tuple[int, ...]:
    if not isinstance(value, list) or not value or any(isinstance(x, bool) or x not in (1, 2, 3, 4) for x in value):
        raise OptionError(f"{what}: not a list of fields 1 to 4")
    return tuple(dict.fromkeys(map(int, value)))


def _names(allowed: tuple[str, ...]):
    def read(value: Any, what: str) -> tuple[str, ...]:
        if not isinstance(value, list):
            raise OptionError(f"{what}: not a list")
        return tuple(dict.fromkeys(_one_of(x, allowed, what) for x in value))

    return read


def _columns(value: Any, what: str) -> tuple[str, ...]:
    found = _names(TABLE_COLUMNS)(value, what)
    if not found:
        raise OptionError(f"{what}: empty")
    return found


def _strings(value: Any, what: str) -> tuple[str, ...]:
    if not isinstance(value, list):
        raise OptionError(f"{what}: not a list")
    return tuple(_string(x, what) for x in value)


def _precision(value: Any, what: str) -> int:
    if _number(value, what) not in range(1, 18):
        raise OptionError(f"{what}: not a whole number from 1 to 17")
    return int(value)


def _or_none(read):
    return lambda value, what: None if value is None else read(value, what)


_KEYS = {
    "filters": {"min_cw": ("min_cw", _or_none(_number)), "min_z": ("min_z", _or_none(_number))},
    "dot": {
        "graph_name": ("graph_name", _string), "directed": ("directed", _bool), "charset": ("charset", _string), "overlap": ("overlap", _bool),
        "outputorder": ("outputorder", _string), "fontname": ("graph_fontname", _string), "sep": ("sep", _string), "pack": ("pack", _bool),
        "packmode": ("packmode", _string), "splines": ("splines", _string),
    },
    "node": {
        "shape": ("node_shape", _string), "fontname": ("node_fontname", _string), "label_fields": ("label_fields", _fields),
        "label_field": ("label_fields", lambda v, what: _fields([v], what)), "label_separator": ("label_separator", _string),
        "font_size_by": ("font_size_by", lambda v, what: _one_of(v, SIZES, what)), "min_font_size": ("min_font_size", _positive), "max_font_size": ("max_font_size", _positive),
    },
    "edge": {
        "label": ("edge_label", lambda v, what: _one_of(v, EDGE_LABELS, what)), "tooltip": ("tooltip", _names(TOOLTIPS)), "penwidth": ("penwidth", _positive),
        "length": ("edge_length", _positive), "len": ("edge_length", _positive), "fontname": ("edge_fontname", _string),
    },
    "table": {
        "columns": ("columns", _columns), "headers": ("headers", _strings), "label_fields": ("table_label_fields", _fields), "label_separator": ("table_label_separator", _string),
        "precision": ("precision", _precision), "unit_separator": ("unit_separator", _string), "caption": ("caption", _or_none(_string)), "label": ("table_label", _or_none(_string)),
    },
}


def load_config(text: str, path: str = "") -> Config:
    """A configuration from JSON; unknown keys are ignored, invalid values raise."""

    def refuse(name: str) -> None:
        raise OptionError(f"not a JSON number: {name}")

    try:
        read = json.loads(text, parse_constant=refuse)
    except json.JSONDecodeError as e:
        raise OptionError(f"{path or 'configuration'}: {e}") from e
    if not isinstance(read, dict):
        raise OptionError("a configuration is an object")
    values: dict[str, Any] = {"path": path}
    if "format" in read:
        values["format"] = output_format(read["format"])
    for section, keys in _KEYS.items():
        own = read.get(section, {})
        if not isinstance(own, dict):
            raise OptionError(f"{section}: not an object")
        for key, value in own.items():
            if key in keys:
                name, parse = keys[key]
                values[name] = parse(value, f"{section}.{key}")
    return Config(**values)


def override(config: Config, format: str | None = None, min_cw: float | None = None, min_z: float | None = None) -> Config:
    """What the command line says goes before the file."""
    changed: dict[str, Any] = {k: v for k, v in (("min_cw", min_cw), ("min_z", min_z)) if v is not None}
    return replace(config, **changed, **({"format": output_format(format)} if format else {}))


def as_read_config(config: Config, change: Callable[[str], str]) -> Config:
    """The configuration with its texts changed, as those of files are by how they are read."""
    texts = {k: change(v) for k, v in vars(config).items() if isinstance(v, str)}
    return replace(config, **texts, headers=tuple(map(change, config.headers)))
