"""The dialect's functions as Spark SQL: one template per name.

A template is text with ``{0}``, ``{1}``, ... for the arguments and ``{*}`` for all of them, or a function of the
argument texts.  Names that Spark shares with the dialect, arguments and all, have no template and pass through.
Functions that no expression can state call a vectorised Python function, registered under a ``basalt_`` name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Template = str | Callable[[list[str]], str]


def _n(**by_count: str) -> Callable[[list[str]], str]:
    """A template chosen by the number of arguments: ``a1=...`` for one, ``a2=...`` for two."""

    def pick(args: list[str]) -> str:
        t = by_count.get(f"a{len(args)}")
        if t is None:
            raise ValueError(f"wrong number of arguments: {len(args)}")
        return fill(t, args)

    return pick


def fill(template: Template, args: list[str]) -> str:
    """A template with its arguments put in."""
    if callable(template):
        return template(args)
    if any(int(n) >= len(args) for n in re.findall(r"\{(\d)\}", template)):
        raise ValueError(f"too few arguments: {len(args)}")
    return re.sub(r"\{(\d|\*)\}", lambda m: ", ".join(args) if m[1] == "*" else args[int(m[1])], template)


def _case_any_null(f: str) -> Callable[[list[str]], str]:
    return lambda a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {f}({', '.join(a)}) END"


def _quoted(delimiter: str) -> str:
    return f"concat('\\\\Q', {delimiter}, '\\\\E')"


def formatted(args: list[str]) -> str:
    """FORMAT by ``format_string``; in a literal format %t is a value as text, %T as a literal, and %'d groups digits."""
    if not args[0].startswith("'"):
        return f"format_string({', '.join(args)})"
    values, n = list(args), 0

    def element(m: re.Match) -> str:
        nonlocal n
        flags, kind = m[1].replace("\\'", ",").replace("'", ","), m[2]
        if kind == "%":
            return "%%"
        n += 1 + flags.count("*")
        if kind not in "tT":
            return f"%{flags}{kind}"
        x = args[n]
        text = f"CAST({x} AS STRING)"
        if kind == "T":
            quoted = "concat('\"', " + text + ", '\"')"
            named = " ".join(f"WHEN '{t}' THEN concat('{d} ', {quoted})" for t, d in (("date", "DATE"), ("timestamp", "TIMESTAMP"), ("timestamp_ntz", "DATETIME")))
            text = f"CASE typeof({x}) WHEN 'string' THEN {quoted} {named} ELSE {text} END"
        values[n] = f"coalesce({text}, 'NULL')"
        return f"%{flags}s"

    values[0] = re.sub(r"%((?:\\'|[-+ #0-9.*'])*)([a-zA-Z%])", element, args[0])
    return f"format_string({', '.join(values)})"


STRING: dict[str, Template] = {
    "CHARACTER_LENGTH": "char_length({0})",
    "LENGTH": "length({0})",
    "BYTE_LENGTH": "octet_length({0})",
    "TRIM": _n(a1="trim({0})", a2="trim(BOTH {1} FROM {0})"),
    "LTRIM": _n(a1="ltrim({0})", a2="trim(LEADING {1} FROM {0})"),
    "RTRIM": _n(a1="rtrim({0})", a2="trim(TRAILING {1} FROM {0})"),
    "SUBSTR": _n(a2="substring({0}, greatest({1}, -length({0})))", a3="substring({0}, greatest({1}, -length({0})), {2})"),
    "SUBSTRING": _n(a2="substring({0}, greatest({1}, -length({0})))", a3="substring({0}, greatest({1}, -length({0})), {2})"),
    "STARTS_WITH": "startswith({0}, {1})",
    "ENDS_WITH": "endswith({0}, {1})",
    "CONTAINS": "contains({0}, {1})",
    "STRPOS": "CAST(instr({0}, {1}) AS BIGINT)",
    "INSTR": _n(
        a2="CAST(instr({0}, {1}) AS BIGINT)",
        a3="CAST(locate({1}, {0}, {2}) AS BIGINT)",
        a4="CAST(aggregate(sequence(1, {3}), {2} - 1, (p, k) -> IF(p < 0, p, locate({1}, {0}, CAST(p + 1 AS INT)) - IF(locate({1}, {0}, CAST(p + 1 AS INT)) = 0, 1, 0)), p -> greatest(p, 0)) AS BIGINT)",
    ),
    "SPLIT": _n(a1="split({0}, ',')", a2=f"IF({{1}} = '', filter(split({{0}}, ''), c -> c <> ''), split({{0}}, {_quoted('{1}')}))"),
    "FORMAT": lambda a: formatted(a),
    "INITCAP": _n(a1="initcap({0})", a2="array_join(transform(split({0}, '(?<=[' || {1} || '])'), w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), '')"),
    "LPAD": _n(a2="lpad({0}, {1})", a3="lpad({0}, {1}, {2})"),
    "RPAD": _n(a2="rpad({0}, {1})", a3="rpad({0}, {1}, {2})"),
    "NORMALIZE": _n(a1="basalt_normalize({0}, 'NFC')", a2="basalt_normalize({0}, '{1}')"),
    "NORMALIZE_AND_CASEFOLD": _n(a1="basalt_casefold({0}, 'NFC')", a2="basalt_casefold({0}, '{1}')"),
    "TO_CODE_POINTS": "transform(filter(split({0}, ''), c -> c <> ''), c -> CAST(ascii(c) AS BIGINT))",
    "CODE_POINTS_TO_STRING": "basalt_code_points({0})",
    "CODE_POINTS_TO_BYTES": "unhex(array_join(transform({0}, c -> lpad(hex(c), 2, '0')), ''))",
    "CHR": "basalt_code_points(array({0}))",
    "UNICODE": "CAST(ascii({0}) AS BIGINT)",
    "ASCII": "CAST(ascii({0}) AS BIGINT)",
    "REGEXP_CONTAINS": "regexp_like({0}, {1})",
    "REGEXP_EXTRACT": lambda a: f"IF(regexp_like({a[0]}, {a[1]}), regexp_extract({a[0]}, {a[1]}, {int(_has_group(a[1]))}), NULL)",
    "REGEXP_EXTRACT_ALL": lambda a: f"regexp_extract_all({a[0]}, {a[1]}, {int(_has_group(a[1]))})",
    "REGEXP_REPLACE": lambda a: f"regexp_replace({a[0]}, {a[1]}, {_dollar(a[2])})",
    "EDIT_DISTANCE": lambda a: f"CAST(levenshtein({a[0]}, {a[1]}) AS BIGINT)" if len(a) == 2 else f"least(CAST(levenshtein({a[0]}, {a[1]}) AS BIGINT), {a[2].split('=>')[-1].strip()})",
    "CONTAINS_SUBSTR": "contains(lower(CAST({0} AS STRING)), lower({1}))",
    "SOUNDEX": "soundex({0})",
    "COLLATE": "collate({0}, CASE {1} WHEN 'und:ci' THEN 'UTF8_LCASE' ELSE 'UTF8_BINARY' END)",
}


def _has_group(pattern: str) -> bool:
    depth_free = pattern.replace("\\\\", "").replace("\\(", "")
    return any(depth_free[i] == "(" and depth_free[i + 1 : i + 2] != "?" for i in range(len(depth_free)))


def _dollar(replacement: str) -> str:
    for i in range(10):
        replacement = replacement.replace(f"\\\\{i}", f"${i}").replace(f"\\{i}", f"${i}")
    return replacement


MATH: dict[str, Template] = {
    "FLOOR": "CAST(floor({0}) AS DOUBLE)",
    "CEIL": "CAST(ceil({0}) AS DOUBLE)",
    "CEILING": "CAST(ceil({0}) AS DOUBLE)",
    "TRUNC": _n(a1="sign({0}) * CAST(floor(abs({0})) AS DOUBLE)", a2="sign({0}) * CAST(floor(abs({0}) * pow(10, {1})) AS DOUBLE) / pow(10, {1})"),
    "TRUNCATE": _n(a1="sign({0}) * CAST(floor(abs({0})) AS DOUBLE)", a2="sign({0}) * CAST(floor(abs({0}) * pow(10, {1})) AS DOUBLE) / pow(10, {1})"),
    "DIV": "(({0}) div ({1}))",
    "SIGN": "CAST(signum({0}) AS BIGINT)",
    "LN": "CASE WHEN {0} > 0 THEN ln({0}) WHEN {0} = 0 THEN -double('infinity') WHEN {0} < 0 THEN double('NaN') END",
    "LOG": _n(a1="log10({0})", a2="log({1}, {0})"),
    "GREATEST": _case_any_null("greatest"),
    "LEAST": _case_any_null("least"),
    "SAFE_DIVIDE": "try_divide(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))",
    "SAFE_MULTIPLY": "try_multiply({0}, {1})",
    "SAFE_ADD": "try_add({0}, {1})",
    "SAFE_SUBTRACT": "try_subtract({0}, {1})",
    "SAFE_NEGATE": "try_subtract(0, {0})",
    "IEEE_DIVIDE": "CASE WHEN {0} IS NULL OR {1} IS NULL THEN NULL WHEN {1} <> 0 THEN CAST({0} AS DOUBLE) / {1} WHEN {0} > 0 THEN double('infinity') WHEN {0} < 0 THEN -double('infinity') ELSE double('NaN') END",
    "IS_NAN": "isnan({0})",
    "IS_INF": "(abs(CAST({0} AS DOUBLE)) = double('infinity'))",
    "COTH": "(1 / tanh({0}))",
    "CSCH": "(1 / sinh({0}))",
    "SECH": "(1 / cosh({0}))",
    "COSINE_DISTANCE": "(1 - aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v) / (sqrt(aggregate({0}, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)) * sqrt(aggregate({1}, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v))))",
    "EUCLIDEAN_DISTANCE": "sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, v) -> s + v))",
    "RANGE_BUCKET": "CAST(size(filter({1}, b -> b <= {0})) AS BIGINT)",
    "BIT_COUNT": "CAST(bit_count({0}) AS BIGINT)",
}

CONDITIONAL: dict[str, Template] = {
    "STRING": _n(a1="CAST({0} AS STRING)", a2="CAST(from_utc_timestamp({0}, {1}) AS STRING)"),
    "ERROR": "raise_error({0})",
    "GENERATE_UUID": "uuid()",
    "SESSION_USER": "current_user()",
    "NULLIFZERO": "nullif({0}, 0)",
    "ZEROIFNULL": "coalesce({0}, 0)",
    "SAFE_CONVERT": "try_cast({0} AS {1})",
}

ENCODING: dict[str, Template] = {
    "TO_BASE64": "base64({0})",
    "FROM_BASE64": "unbase64({0})",
    "TO_BASE32": "basalt_to_base32({0})",
    "FROM_BASE32": "basalt_from_base32({0})",
    "TO_HEX": "lower(hex({0}))",
    "FROM_HEX": "unhex({0})",
    "CONVERT_BYTES_TO_STRING": "validate_utf8(CAST({0} AS STRING))",
    "SAFE_CONVERT_BYTES_TO_STRING": "make_valid_utf8(CAST({0} AS STRING))",
    "MD5": "unhex(md5({0}))",
    "SHA1": "unhex(sha1({0}))",
    "SHA256": "unhex(sha2({0}, 256))",
    "SHA512": "unhex(sha2({0}, 512))",
    "FARM_FINGERPRINT": "basalt_farm_fingerprint(CAST({0} AS BINARY))",
    "NET.HOST": "basalt_net_host({0})",
    "NET.REG_DOMAIN": "basalt_net_reg_domain({0})",
    "NET.PUBLIC_SUFFIX": "basalt_net_public_suffix({0})",
    "NET.IP_FROM_STRING": "basalt_ip_from_string({0}, true)",
    "NET.SAFE_IP_FROM_STRING": "basalt_ip_from_string({0}, false)",
    "NET.IP_TO_STRING": "basalt_ip_to_string({0})",
    "NET.IP_NET_MASK": "basalt_ip_net_mask(CAST({0} AS INT), CAST({1} AS INT))",
    "NET.IP_TRUNC": "basalt_ip_trunc({0}, CAST({1} AS INT))",
    "NET.IP_IN_NET": "basalt_ip_in_net({0}, {1})",
    "NET.IP_IS_PRIVATE": "basalt_ip_is_private({0})",
    "NET.MAKE_NET": "basalt_make_net({0}, CAST({1} AS INT))",
    "NET.IPV4_TO_INT64": "CAST(conv(hex({0}), 16, 10) AS BIGINT)",
    "NET.IPV4_FROM_INT64": "unhex(lpad(hex(({0}) & 4294967295), 8, '0'))",
    "AEAD.ENCRYPT": "aes_encrypt({1}, {0}, 'GCM', 'DEFAULT', '', {2})",
    "AEAD.DECRYPT_BYTES": "aes_decrypt({1}, {0}, 'GCM', 'DEFAULT', {2})",
    "AEAD.DECRYPT_STRING": "CAST(aes_decrypt({1}, {0}, 'GCM', 'DEFAULT', {2}) AS STRING)",
    "HLL_COUNT.INIT": "hll_sketch_agg({0})",
    "HLL_COUNT.EXTRACT": "hll_sketch_estimate({0})",
    "HLL_COUNT.MERGE": "hll_sketch_estimate(hll_union_agg({0}))",
}

def _array_slice(a: list[str]) -> str:
    """Elements from ``start`` (from 1; negative ones from the end) up to ``end``; a negative end leaves so many out."""
    x, start, end = (f"({v})" for v in a)
    low = f"CASE WHEN {start} < 0 THEN greatest(size({x}) + {start}, 0) WHEN {start} = 0 THEN 0 ELSE least({start} - 1, size({x})) END"
    high = f"CASE WHEN {end} < 0 THEN greatest(size({x}) + {end}, 0) ELSE least({end}, size({x})) END"
    return f"slice({x}, CAST({low} AS INT) + 1, CAST(greatest({high} - {low}, 0) AS INT))"


ARRAY: dict[str, Template] = {
    "ARRAY_LENGTH": "CAST(array_size({0}) AS BIGINT)",
    "ARRAY_TO_STRING": _n(a2="array_join({0}, {1})", a3="array_join({0}, {1}, {2})"),
    "ARRAY_CONCAT": "concat({*})",
    "ARRAY_REVERSE": "reverse({0})",
    "GENERATE_ARRAY": _n(
        a2="IF({0} > {1}, array(), sequence({0}, {1}))",
        a3="transform(sequence(0, CAST(floor(({1} - {0}) / ({2})) AS BIGINT) + IF(({1} - {0}) / ({2}) < 0, NULL, 0)), i -> {0} + i * ({2}))",
    ),
    "ARRAY_FIRST": "element_at({0}, 1)",
    "ARRAY_LAST": "element_at({0}, -1)",
    "ARRAY_FIRST_N": "slice({0}, 1, {1})",
    "ARRAY_LAST_N": "slice({0}, greatest(size({0}) - {1}, 0) + 1, {1})",
    "ARRAY_SLICE": _array_slice,
    "ARRAY_SUM": "aggregate({0}, CAST(0 AS DOUBLE), (s, v) -> s + coalesce(v, 0))",
    "ARRAY_AVG": "(aggregate({0}, CAST(0 AS DOUBLE), (s, v) -> s + coalesce(v, 0)) / nullif(size(array_compact({0})), 0))",
    "ARRAY_INCLUDES": "array_contains({0}, {1})",
    "ARRAY_INCLUDES_ANY": "arrays_overlap({0}, {1})",
    "ARRAY_INCLUDES_ALL": "(size(array_except({1}, {0})) = 0)",
    "ARRAY_FLATTEN": "flatten({0})",
    "ARRAY_POSITION": "array_position({0}, {1})",
    "ARRAY_ZIP": "arrays_zip({*})",
    "ARRAYENUMERATE": "IF(size({0}) = 0, array(), sequence(1, size({0})))",
    "GENERATE_DATE_ARRAY": _n(a2="IF({0} > {1}, array(), sequence({0}, {1}, INTERVAL 1 DAY))", a3="IF({0} > {1}, array(), sequence({0}, {1}, {2}))"),
    "GENERATE_TIMESTAMP_ARRAY": "IF({0} > {1}, array(), sequence({0}, {1}, {2}))",
    "MAP_KEYS": "map_keys({0})",
    "MAP_VALUES": "map_values({0})",
    "SAFE_OFFSET": "get({0}, {1})",
    "SAFE_ORDINAL": "get({0}, ({1}) - 1)",
    "OFFSET": "element_at({0}, ({1}) + 1)",
    "ORDINAL": "element_at({0}, {1})",
}

def _json_text(a: list[str]) -> str:
    made = f"to_json(named_struct('v', {a[0]}), map('ignoreNullFields', 'false'))"
    return f"substring({made}, 6, length({made}) - 6)"


JSON: dict[str, Template] = {
    # JSON is text: what is parsed is checked and kept, and any value is written through a field of a struct.
    "TO_JSON": _json_text,
    "TO_JSON_STRING": _json_text,
    "PARSE_JSON": "CASE WHEN {0} IS NULL THEN NULL WHEN try_parse_json({0}) IS NULL THEN raise_error('invalid JSON') ELSE to_json(parse_json({0})) END",
    "JSON_QUERY": "get_json_object({0}, {1})",
    "JSON_EXTRACT": "get_json_object({0}, {1})",
    "JSON_VALUE": "IF(substring(ltrim(get_json_object({0}, {1})), 1, 1) IN ('{{', '['), NULL, get_json_object({0}, {1}))".replace("{{", "{"),
    "JSON_EXTRACT_SCALAR": "IF(substring(ltrim(get_json_object({0}, {1})), 1, 1) IN ('{{', '['), NULL, get_json_object({0}, {1}))".replace("{{", "{"),
    "JSON_QUERY_ARRAY": _n(a1="from_json({0}, 'array<string>')", a2="from_json(get_json_object({0}, {1}), 'array<string>')"),
    "JSON_EXTRACT_ARRAY": _n(a1="from_json({0}, 'array<string>')", a2="from_json(get_json_object({0}, {1}), 'array<string>')"),
    "JSON_VALUE_ARRAY": _n(a1="from_json({0}, 'array<string>')", a2="from_json(get_json_object({0}, {1}), 'array<string>')"),
    "JSON_EXTRACT_STRING_ARRAY": _n(a1="from_json({0}, 'array<string>')", a2="from_json(get_json_object({0}, {1}), 'array<string>')"),
    "JSON_KEYS": "json_object_keys({0})",
    "JSON_ARRAY_LENGTH": "CAST(json_array_length({0}) AS BIGINT)",
    "JSON_TYPE": "CASE substring(ltrim({0}), 1, 1) WHEN '{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE 'number' END",
    "JSON_OBJECT": lambda a: "to_json(named_struct(" + ", ".join(a) + "))",
    "JSON_ARRAY": "to_json(array({*}))",
    "JSON_SET": "basalt_json_set({0}, {1}, to_json(struct({2} AS v)))",
    "JSON_REMOVE": "basalt_json_remove({0}, {1})",
    "JSON_STRIP_NULLS": "basalt_json_strip_nulls({0})",
    "LAX_INT64": "CAST(try_cast(trim(BOTH '\"' FROM {0}) AS DOUBLE) AS BIGINT)",
    "LAX_FLOAT64": "try_cast(trim(BOTH '\"' FROM {0}) AS DOUBLE)",
    "LAX_BOOL": "CASE WHEN lower(trim(BOTH '\"' FROM {0})) IN ('true', 'false') THEN lower(trim(BOTH '\"' FROM {0})) = 'true' ELSE try_cast({0} AS DOUBLE) <> 0 END",
    "LAX_STRING": "trim(BOTH '\"' FROM {0})",
    "INT64": "CAST({0} AS BIGINT)",
    "FLOAT64": "CAST({0} AS DOUBLE)",
    "BOOL": "CAST({0} AS BOOLEAN)",
}

RANGE: dict[str, Template] = {
    "RANGE": "named_struct('start', {0}, 'end', {1})",
    "RANGE_START": "({0}).start",
    "RANGE_END": "({0}).end",
    "RANGE_CONTAINS": "((({0}).start IS NULL OR {1} >= ({0}).start) AND (({0}).end IS NULL OR {1} < ({0}).end))",
    "RANGE_OVERLAPS": "((({0}).start IS NULL OR ({1}).end IS NULL OR ({0}).start < ({1}).end) AND (({1}).start IS NULL OR ({0}).end IS NULL OR ({1}).start < ({0}).end))",
    "RANGE_INTERSECT": "named_struct('start', greatest(({0}).start, ({1}).start), 'end', least(({0}).end, ({1}).end))",
    "RANGE_IS_EMPTY": "coalesce(({0}).start >= ({0}).end, false)",
    "GENERATE_RANGE_ARRAY": "transform(filter(sequence(({0}).start, ({0}).end, {1}), x -> x < ({0}).end), x -> named_struct('start', x, 'end', least(CAST(x + {1} AS DATE), ({0}).end)))",
}

GEOGRAPHY: dict[str, Template] = {
    "ST_GEOGPOINT": "format_string('POINT(%s %s)', CAST({0} AS STRING), CAST({1} AS STRING))",
    "ST_GEOGFROMTEXT": "basalt_st_parse({0})",
    "ST_ASTEXT": "({0})",
    "ST_X": "CAST(regexp_extract({0}, 'POINT *\\\\(([-0-9.eE]+)', 1) AS DOUBLE)",
    "ST_Y": "CAST(regexp_extract({0}, 'POINT *\\\\([-0-9.eE]+ +([-0-9.eE]+)', 1) AS DOUBLE)",
    "ST_DISTANCE": "basalt_st_distance({0}, {1})",
    "ST_DWITHIN": "(basalt_st_distance({0}, {1}) <= {2})",
    "ST_MAXDISTANCE": "basalt_st_measure2({0}, {1}, 'maxdistance')",
    "ST_MAKELINE": _n(a1="basalt_st_line({0})", a2="basalt_st_make2({0}, {1}, 'line')"),
    "ST_MAKEPOLYGON": "if(startswith({0}, 'LINESTRING('), concat('POLYGON(', substring({0}, 11), ')'), {0})",
    "ST_ASBINARY": "encode({0}, 'UTF-8')",
    "ST_GEOGFROMWKB": "basalt_st_from_wkb({0})",
    "ST_SIMPLIFY": "basalt_st_shape({0}, CAST({1} AS DOUBLE), 'simplify')",
    "ST_SNAPTOGRID": "basalt_st_shape({0}, CAST({1} AS DOUBLE), 'snap')",
    "ST_BUFFER": "basalt_st_shape({0}, CAST({1} AS DOUBLE), 'buffer')",
    "ST_BUFFERWITHTOLERANCE": "basalt_st_shape({0}, CAST({1} AS DOUBLE), 'buffer')",
    "ST_CLOSESTPOINT": "basalt_st_combine({0}, {1}, 'closest')",
    "ST_UNION": "basalt_st_combine({0}, {1}, 'union')",
    "ST_INTERSECTION": "basalt_st_combine({0}, {1}, 'intersection')",
    "ST_DIFFERENCE": "basalt_st_combine({0}, {1}, 'difference')",
    "ST_TOUCHES": "(basalt_st_measure2({0}, {1}, 'touches') = 1)",
    "ST_GEOHASH": _n(a1="basalt_st_geohash({0}, 20)", a2="basalt_st_geohash({0}, CAST({1} AS INT))"),
    "ST_GEOGPOINTFROMGEOHASH": "basalt_st_from_geohash({0})",
    "ST_ASGEOJSON": "basalt_st_text({0}, 'geojson')",
    "ST_GEOGFROMGEOJSON": "basalt_st_text({0}, 'fromgeojson')",
    "ST_GEOMETRYTYPE": "basalt_st_text({0}, 'type')",
    "ST_DIMENSION": "CAST(basalt_st_number({0}, 'dimension') AS BIGINT)",
    "ST_NUMPOINTS": "CAST(basalt_st_number({0}, 'numpoints') AS BIGINT)",
    "ST_LENGTH": "basalt_st_number({0}, 'length')",
    "ST_PERIMETER": "basalt_st_number({0}, 'perimeter')",
    "ST_AREA": "basalt_st_number({0}, 'area')",
    "ST_ISEMPTY": "(basalt_st_number({0}, 'numpoints') = 0)",
    "ST_ISCLOSED": "(basalt_st_number({0}, 'closed') = 1)",
    "ST_ISRING": "(basalt_st_number({0}, 'ring') = 1)",
    "ST_ISCOLLECTION": "(basalt_st_number({0}, 'collection') = 1)",
    "ST_STARTPOINT": "basalt_st_text({0}, 'start')",
    "ST_ENDPOINT": "basalt_st_text({0}, 'end')",
    "ST_POINTN": "basalt_st_pointn({0}, CAST({1} AS INT))",
    "ST_CENTROID": "basalt_st_text({0}, 'centroid')",
    "ST_CONVEXHULL": "basalt_st_text({0}, 'hull')",
    "ST_BOUNDINGBOX": "basalt_st_text({0}, 'box')",
    "ST_BOUNDARY": "basalt_st_text({0}, 'boundary')",
    "ST_CONTAINS": "(basalt_st_measure2({0}, {1}, 'contains') = 1)",
    "ST_COVERS": "(basalt_st_measure2({0}, {1}, 'contains') = 1)",
    "ST_WITHIN": "(basalt_st_measure2({1}, {0}, 'contains') = 1)",
    "ST_COVEREDBY": "(basalt_st_measure2({1}, {0}, 'contains') = 1)",
    "ST_INTERSECTS": "(basalt_st_measure2({0}, {1}, 'intersects') = 1)",
    "ST_DISJOINT": "(basalt_st_measure2({0}, {1}, 'intersects') = 0)",
    "ST_EQUALS": "(basalt_st_measure2({0}, {1}, 'equals') = 1)",
}

_UNIT = {"DAY": "86400000000", "HOUR": "3600000000", "MINUTE": "60000000", "SECOND": "1000000", "MILLISECOND": "1000", "MICROSECOND": "1", "WEEK": "604800000000"}


def add(args: list[str], sign: str) -> str:
    """``x + INTERVAL n PART`` (or ``-``)."""
    value, interval = args[0], args[1].strip()
    if interval.upper().startswith("INTERVAL"):
        body = interval[8:].strip()
        n, part = body.rsplit(None, 1)
        part = part.upper()
        if part == "QUARTER":
            n, part = f"3 * ({n})", "MONTH"
        if part in ("YEAR", "MONTH"):
            made = f"make_ym_interval({'(' + n + ')' if part == 'YEAR' else '0'}, {'(' + n + ')' if part == 'MONTH' else '0'})"
        elif part == "WEEK":
            made = f"make_dt_interval(7 * ({n}))"
        elif part in ("DAY", "HOUR", "MINUTE", "SECOND"):
            at = ("DAY", "HOUR", "MINUTE", "SECOND").index(part)
            made = "make_dt_interval(" + ", ".join(["0"] * at + [f"({n})"]) + ")"
        else:
            made = f"make_dt_interval(0, 0, 0, ({n}) / {1000 if part == 'MILLISECOND' else 1000000}D)"
        return f"({value} {sign} {made})"
    return f"({value} {sign} {interval})"


def date_add(args: list[str], sign: str) -> str:
    return f"CAST({add(args, sign)} AS DATE)"


def diff(args: list[str]) -> str:
    """Boundary counts for calendar parts, whole units for clock parts; ISO and Sunday weeks as their first days."""
    a, b, part = args[0], args[1], args[2].strip().upper()
    months = f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"
    if part == "YEAR":
        return f"CAST(year({a}) - year({b}) AS BIGINT)"
    if part == "QUARTER":
        return f"CAST((year({a}) - year({b})) * 4 + quarter({a}) - quarter({b}) AS BIGINT)"
    if part == "MONTH":
        return f"CAST({months} AS BIGINT)"
    if part == "WEEK":
        return f"CAST(datediff({a}, {b}) div 7 AS BIGINT)"
    if part == "DAY":
        return f"CAST(datediff({a}, {b}) AS BIGINT)"
    return f"((unix_micros(CAST({a} AS TIMESTAMP)) - unix_micros(CAST({b} AS TIMESTAMP))) div {_UNIT[part]})"


def stamp_diff(args: list[str]) -> str:
    part = args[2].strip().upper()
    if part in ("DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"):
        return f"((unix_micros(CAST({args[0]} AS TIMESTAMP)) - unix_micros(CAST({args[1]} AS TIMESTAMP))) div {_UNIT[part]})"
    return diff(args)


def trunc_date(args: list[str]) -> str:
    d, part = args[0], args[1].strip().upper()
    if part == "DAY":
        return f"CAST({d} AS DATE)"
    if part == "WEEK(SUNDAY)":
        return f"CAST(date_sub({d}, dayofweek({d}) - 1) AS DATE)"
    return f"trunc({d}, '{'WEEK' if part in ('WEEK', 'ISOWEEK', 'WEEK(MONDAY)') else part}')"


def trunc_stamp(args: list[str]) -> str:
    """The start of a part; WEEK starts on Sunday here and ISOWEEK on Monday."""
    t, part = args[0], args[1].strip().upper()
    if part in ("WEEK", "WEEK(SUNDAY)"):
        return f"(date_trunc('WEEK', {t} + INTERVAL 1 DAY) - INTERVAL 1 DAY)"
    return f"date_trunc('{'WEEK' if part in ('ISOWEEK', 'WEEK(MONDAY)') else part}', {t})"


def _width(interval: str) -> str:
    n, part = interval.strip()[8:].strip().rsplit(None, 1)
    return f"(({n}) * {_UNIT[part.upper()]})"


def bucket(kind: str) -> Callable[[list[str]], str]:
    """The start of the fixed-width bucket a value falls in; buckets begin at the origin, 1950-01-01 by default."""

    def make(args: list[str]) -> str:
        value, w = args[0], _width(args[1])
        origin = args[2] if len(args) > 2 else "DATE'1950-01-01'"
        micros = lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))"
        at = f"({micros(origin)} + CAST(floor(({micros(value)} - {micros(origin)}) / CAST({w} AS DOUBLE)) AS BIGINT) * {w})"
        return f"CAST(timestamp_micros({at}) AS {kind})"

    return make


#: strftime letters as Java date patterns; each is a fixed value of one of the two notations.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "E", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "Z": "z", "z": "xx", "f": "SSSSSS", "e": "d", "n": "\n", "t": "\t", "%": "%"}


def java_pattern(fmt: str) -> str:
    """A quoted strftime format as a quoted Java pattern; literal letters are quoted."""
    text, out, i, plain = fmt[1:-1], [], 0, ""

    def flush():
        nonlocal plain
        if plain:
            out.append("\\'" + plain + "\\'" if any(c.isalpha() for c in plain) else plain)
            plain = ""

    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            flush()
            if text[i + 1] not in STRFTIME:
                raise ValueError(f"format element %{text[i + 1]} is not supported")
            out.append(STRFTIME[text[i + 1]])
            i += 2
        else:
            plain += text[i]
            i += 1
    flush()
    return "'" + "".join(out) + "'"


DATETIME: dict[str, Template] = {
    "NOW": "current_timestamp()",
    "CURRENT_DATETIME": "localtimestamp()",
    "DATE_ADD": lambda a: date_add(a, "+"),
    "DATE_SUB": lambda a: date_add(a, "-"),
    "DATETIME_ADD": lambda a: add(a, "+"),
    "DATETIME_SUB": lambda a: add(a, "-"),
    "TIMESTAMP_ADD": lambda a: add(a, "+"),
    "TIMESTAMP_SUB": lambda a: add(a, "-"),
    "TIME_ADD": lambda a: add(a, "+"),
    "TIME_SUB": lambda a: add(a, "-"),
    "DATE_DIFF": diff,
    "DATEDIFF": diff,
    "DATETIME_DIFF": stamp_diff,
    "TIMESTAMP_DIFF": stamp_diff,
    "TIME_DIFF": lambda a: f"time_diff('{a[2].strip()}', {a[1]}, {a[0]})",
    "DATE_TRUNC": trunc_date,
    "DATETIME_TRUNC": trunc_stamp,
    "TIMESTAMP_TRUNC": trunc_stamp,
    "TIME_TRUNC": lambda a: f"time_trunc('{a[1].strip()}', {a[0]})",
    "DATE_BUCKET": bucket("DATE"),
    "DATETIME_BUCKET": bucket("TIMESTAMP_NTZ"),
    "TIMESTAMP_BUCKET": bucket("TIMESTAMP"),
    "DATE": _n(a1="CAST({0} AS DATE)", a2="CAST(from_utc_timestamp({0}, {1}) AS DATE)", a3="make_date({0}, {1}, {2})"),
    "TIME": _n(a1="CAST({0} AS TIME)", a3="make_time({0}, {1}, {2})"),
    "DATETIME": _n(a1="CAST({0} AS TIMESTAMP_NTZ)", a2="CAST(concat_ws(' ', {0}, {1}) AS TIMESTAMP_NTZ)", a6="make_timestamp_ntz({*})"),
    "TIMESTAMP": _n(a1="CAST({0} AS TIMESTAMP)", a2="to_utc_timestamp(CAST({0} AS TIMESTAMP), {1})"),
    "UNIX_DATE": "CAST(unix_date({0}) AS BIGINT)",
    "UNIX_SECONDS": "unix_seconds(CAST({0} AS TIMESTAMP))",
    "UNIX_MILLIS": "unix_millis(CAST({0} AS TIMESTAMP))",
    "UNIX_MICROS": "unix_micros(CAST({0} AS TIMESTAMP))",
    "LAST_DAY": lambda a: f"last_day({a[0]})",
    "FORMAT_DATE": lambda a: f"date_format({a[1]}, {java_pattern(a[0])})",
    "FORMAT_DATETIME": lambda a: f"date_format({a[1]}, {java_pattern(a[0])})",
    "FORMAT_TIMESTAMP": lambda a: f"date_format({a[1] if len(a) == 2 else f'from_utc_timestamp({a[1]}, {a[2]})'}, {java_pattern(a[0])})",
    "FORMAT_TIME": lambda a: f"date_format(CAST(concat('1970-01-01 ', CAST({a[1]} AS STRING)) AS TIMESTAMP_NTZ), {java_pattern(a[0])})",
    "PARSE_DATE": lambda a: f"to_date({a[1]}, {java_pattern(a[0])})",
    "PARSE_DATETIME": lambda a: f"to_timestamp_ntz({a[1]}, {java_pattern(a[0])})",
    "PARSE_TIMESTAMP": lambda a: f"to_timestamp({a[1]}, {java_pattern(a[0])})",
    "PARSE_TIME": lambda a: f"to_time({a[1]}, {java_pattern(a[0])})",
    "JUSTIFY_DAYS": "named_struct('months', ({0}).months + ({0}).days div 30, 'days', ({0}).days % 30, 'micros', ({0}).micros)",
    "JUSTIFY_HOURS": "named_struct('months', ({0}).months, 'days', ({0}).days + ({0}).micros div 86400000000, 'micros', ({0}).micros % 86400000000)",
    "JUSTIFY_INTERVAL": "if(({0}) IS NULL, NULL, named_struct('months', ({0}).months + (({0}).days + ({0}).micros div 86400000000) div 30, 'days', (({0}).days + ({0}).micros div 86400000000) % 30, 'micros', ({0}).micros % 86400000000))",
    "MAKE_INTERVAL": lambda a: fill("named_struct('months', CAST(12 * ({0}) + {1} AS BIGINT), 'days', CAST({2} AS BIGINT), 'micros', CAST((({3}) * 3600 + ({4}) * 60 + ({5})) * 1000000L AS BIGINT))", (a + ["0"] * 6)[:6]),
}

AGGREGATE: dict[str, Template] = {
    "COUNTIF": "count_if({0})",
    "SUMIF": "sum({0}) FILTER (WHERE {1})",
    "SUM_IF": "sum({0}) FILTER (WHERE {1})",
    "AVGIF": "avg({0}) FILTER (WHERE {1})",
    "AVG_IF": "avg({0}) FILTER (WHERE {1})",
    "MINIF": "min({0}) FILTER (WHERE {1})",
    "MIN_IF": "min({0}) FILTER (WHERE {1})",
    "MAXIF": "max({0}) FILTER (WHERE {1})",
    "MAX_IF": "max({0}) FILTER (WHERE {1})",
    "LOGICAL_AND": "bool_and({0})",
    "LOGICAL_OR": "bool_or({0})",
    "ANY_VALUE": "first({0}, true)",
    "APPROX_COUNT_DISTINCT": "count(DISTINCT {0})",
    "APPROX_QUANTILES": lambda a: f"percentile({a[0]}, array({', '.join(f'{i}D/{int(a[1])}' for i in range(int(a[1]) + 1))}))",
    "APPROX_TOP_COUNT": "transform(approx_top_k({0}, {1}), e -> named_struct('value', e.item, 'count', e.count))",
    "VAR": "variance({0})",
    "XMLAGG": "listagg({0}, '')",
}
TEMPLATES: dict[str, Template] = STRING | MATH | CONDITIONAL | ENCODING | ARRAY | JSON | RANGE | GEOGRAPHY | DATETIME | AGGREGATE
