"""Vectorised Python functions for what Spark has no expression for; each maps Arrow batches of columns."""

from __future__ import annotations

import base64
import ipaddress
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from basalt.functions import geo
from basalt.functions.farm import fingerprint64

#: Registered names with their result types and functions of one row; nulls in, null out.
ROWWISE: dict[str, tuple[str, object]] = {}


def _rowwise(result: str):
    def keep(f):
        ROWWISE["basalt_" + f.__name__] = (result, f)
        return f

    return keep


@_rowwise("string")
def normalize(s, form):
    return unicodedata.normalize(form, s)


@_rowwise("string")
def casefold(s, form):
    return unicodedata.normalize(form, unicodedata.normalize(form, s).casefold())


@_rowwise("string")
def code_points(points):
    return "".join(chr(int(p)) for p in points if p)


@_rowwise("string")
def to_base32(b):
    return base64.b32encode(bytes(b)).decode()


@_rowwise("binary")
def from_base32(s):
    return base64.b32decode(s)


@_rowwise("long")
def farm_fingerprint(b):
    return fingerprint64(bytes(b))


#: Suffixes of two labels under which names are registered; any other name has a one-label suffix.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp ac.jp co.nz com.br com.cn com.mx co.in co.kr com.tr com.sg co.za".split())


@_rowwise("string")
def net_host(url):
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)", url) or re.match(r"\s*([^/?#:@\s]+\.[^/?#:@\s]+)", url)
    return m[1].rstrip(".") if m and m[1] else None


@_rowwise("string")
def net_public_suffix(url):
    host = net_host(url)
    if not host or host.startswith("[") or "." not in host:
        return None
    labels = host.split(".")
    two = ".".join(labels[-2:]).lower()
    return ".".join(labels[-2:]) if two in SUFFIXES else labels[-1]


@_rowwise("string")
def net_reg_domain(url):
    host, suffix = net_host(url), net_public_suffix(url)
    if not suffix:
        return None
    rest = host[: -len(suffix) - 1].split(".")
    return f"{rest[-1]}.{suffix}" if rest[-1] else None


@_rowwise("binary")
def ip_from_string(s, strict):
    try:
        return ipaddress.ip_address(s).packed
    except ValueError:
        if strict:
            raise
        return None


@_rowwise("string")
def ip_to_string(b):
    return str(ipaddress.ip_address(bytes(b)))


@_rowwise("binary")
def ip_net_mask(size, prefix):
    return (((1 << prefix) - 1) << (size * 8 - prefix)).to_bytes(size, "big")


@_rowwise("binary")
def ip_trunc(b, prefix):
    b = bytes(b)
    mask = int.from_bytes(ip_net_mask(len(b), prefix), "big")
    return (int.from_bytes(b, "big") & mask).to_bytes(len(b), "big")


@_rowwise("boolean")
def ip_in_net(ip, net):
    return ipaddress.ip_address(ip) in ipaddress.ip_network(net, strict=False)


@_rowwise("boolean")
def ip_is_private(ip):
    return ipaddress.ip_address(ip).is_private


@_rowwise("string")
def make_net(ip, prefix):
    return str(ipaddress.ip_network(f"{ip}/{prefix}", strict=False))


def _steps(path: str) -> list[str | int]:
    return [int(b) if b else a for a, b in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def _dump(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


@_rowwise("string")
def json_set(doc, path, value):
    root, steps = json.loads(doc), _steps(path)
    new = json.loads(value).get("v")
    if not steps:
        return _dump(new)
    at = root
    for step, following in zip(steps, steps[1:]):
        if isinstance(at, dict):
            at = at.setdefault(step, [] if isinstance(following, int) else {})
        elif isinstance(at, list) and isinstance(step, int) and step < len(at):
            at = at[step]
        else:
            return _dump(root)
    last = steps[-1]
    if isinstance(at, dict):
        at[last] = new
    elif isinstance(at, list) and isinstance(last, int):
        at.extend([None] * (last + 1 - len(at)))
        at[last] = new
    return _dump(root)


@_rowwise("string")
def json_remove(doc, path):
    root, steps = json.loads(doc), _steps(path)
    at = root
    for step in steps[:-1]:
        try:
            at = at[step]
        except (KeyError, IndexError, TypeError):
            return _dump(root)
    if isinstance(at, dict):
        at.pop(steps[-1], None)
    elif isinstance(at, list) and isinstance(steps[-1], int) and steps[-1] < len(at):
        del at[steps[-1]]
    return _dump(root)


@_rowwise("string")
def json_strip_nulls(doc):
    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x if v is not None] if isinstance(x, list) else x

    return _dump(strip(json.loads(doc)))


for _name, _result, _f in geo.FUNCTIONS:
    ROWWISE["basalt_" + _name] = (_result, _f)


KNOWN = 20_000  #: results a worker remembers of each function
KNOWN_CHARS = 256  #: length up to which an argument or a result is remembered


def _vectorised(result: str, f):
    # Rows repeat where arguments are literals or come of few values; each short one is worked out once per task.
    known: dict = {}

    def value(row):
        return None if any(v is None or v != v if not hasattr(v, "__len__") else False for v in row) else f(*row)

    def remembered(row):
        # 1, 1.0 and TRUE are equal, and so are 0.0 and -0.0, but not to every function.
        key = tuple([(type(v), repr(v) if isinstance(v, float) else v) for v in row])
        try:
            return known[key]
        except KeyError:
            pass
        except TypeError:  # an array or a map
            return value(row)
        out = value(row)
        if all(len(v) <= KNOWN_CHARS for v in (*row, out) if hasattr(v, "__len__")):
            if len(known) >= KNOWN:
                known.clear()
            known[key] = out
        return out

    def over(*columns: pd.Series) -> pd.Series:
        return pd.Series([remembered(row) for row in zip(*columns)], dtype=object)

    # A fixed signature per arity: pandas_udf reads the annotations.
    makers = {
        1: lambda a: over(a),
        2: lambda a, b: over(a, b),
        3: lambda a, b, c: over(a, b, c),
    }
    g = makers[f.__code__.co_argcount]
    g.__annotations__ = dict.fromkeys(g.__code__.co_varnames[: f.__code__.co_argcount], pd.Series) | {"return": pd.Series}
    return pandas_udf(g, result)


def register(spark: SparkSession) -> None:
    """Make all of them callable from SQL in this session."""
    for name, (result, f) in ROWWISE.items():
        spark.udf.register(name, _vectorised(result, f))
