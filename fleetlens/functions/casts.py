"""Typed reading of loosely typed values (text and VARIANT leaves).

These helpers take and return SQL text: a column name or any expression goes in, an expression
comes out, to be used with ``F.expr``. Measurement definitions combine hundreds of them, and one
parsed text is far cheaper to build than the same tree made of Column calls.
"""

from __future__ import annotations

# The shapes of text that count as numbers, and the size and truth words.
INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"
DIGITS_TEXT = r"^-?[0-9]+$"
FLOAT_TEXT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
SIZE_TEXT = r"(?i)^([0-9.]+)([KMGT]?)$"
TRUE_WORDS = ("true", "1", "yes", "on")
SIZE_FACTORS = {
    "established": {"K": "1D / 1073741824", "M": "1D / 1048576", "G": "1D", "T": "1024D"},
    "binary": {"K": "1D / 1048576", "M": "1D / 1024", "G": "1D", "T": "1024D"},
}


def bound(value: str, body: str, name: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def exact_round(value: str, digits: int) -> str:
    """Round to ``digits`` places by the exact binary value, true halves to even.

    SQL ``round`` works on the decimal text, so 2.675 (stored just below it) would become 2.68. The
    two differ only when the text ends in a 5 one place further; then the exact value is compared
    with the half, in pieces small enough for every product to be exact. Nothing is to be done for null and whole
    numbers, which most values are (adding zero makes -0 a 0, as rounding does).
    """
    if digits < 0 or digits > 4:
        raise ValueError("digits must be between 0 and 4")
    step, five = f"{10 ** (digits + 1)}D", f"{5 ** (digits + 1)}D"
    high = "cast(cast(t.s as float) as double)"
    beyond = f"(({high} * {five} - t.u) + (t.s - {high}) * {five})"
    down, up = "((t.u - 5) div 10)", "((t.u + 5) div 10)"
    units = f"cast(round(abs(v) * {step}) as bigint)"
    chosen = bound(
        f"named_struct('u', {units}, 's', abs(v) * {2 ** (digits + 1)}D)",
        f"CASE WHEN {beyond} < 0 THEN {down} WHEN {beyond} > 0 THEN {up} WHEN {down} % 2 = 0 THEN {down} ELSE {up} END",
        "t",
    )
    tie = f"abs(v) * {step} < 4503599627370496D AND round(v, {digits + 1}) = v AND {units} % 10 = 5"
    return bound(
        f"cast({value} as double)",
        f"CASE WHEN v IS NULL OR v % 1 = 0 THEN v + 0D WHEN {tie} THEN signum(v) * {chosen} / {10 ** digits}D ELSE round(v, {digits}) END",
        "v",
    )


def int_of_text(value: str) -> str:
    """Whole numbers only: text such as ``12.5`` or ``12d`` gives null."""
    return f"CASE WHEN {value} RLIKE r'{INT_TEXT}' THEN try_cast(trim({value}) AS BIGINT) END"


def double_of_text(value: str) -> str:
    """Any float text; the guard keeps out suffixed forms Java would accept (``12d``)."""
    return f"CASE WHEN {value} RLIKE r'{FLOAT_TEXT}' THEN try_cast(trim({value}) AS DOUBLE) END"


def float_of_text(value: str, precision: int = 2) -> str:
    return exact_round(double_of_text(value), precision)


def percent_of_text(value: str) -> str:
    return bound(f"trim(TRAILING '%' FROM {value})", float_of_text("p"), "p")


def gigabytes_of_text(value: str, units: str = "established") -> str:
    """Size text in GB; empty or missing is 0, anything that is not a size is null.

    ``units='established'`` keeps the established K and M factors, ``'binary'`` the usual ones.
    """
    number = f"try_cast(regexp_extract(s, r'{SIZE_TEXT}', 1) AS DOUBLE)"
    unit = f"upper(regexp_extract(s, r'{SIZE_TEXT}', 2))"
    factors = " ".join(f"WHEN '{letter}' THEN {size}" for letter, size in SIZE_FACTORS[units].items())
    size = f"CASE WHEN s RLIKE r'{SIZE_TEXT}' THEN {number} * CASE {unit} {factors} ELSE 1D END END"
    return bound(
        f"coalesce({value}, '')", f"CASE WHEN g = '' THEN 0D ELSE {bound('trim(g)', size, 's')} END", "g"
    )


def yes_no(value: str) -> str:
    return f"CASE {value} WHEN 'yes' THEN true WHEN 'no' THEN false END"


def loose_boolean(value: str) -> str:
    words = ", ".join(f"'{w}'" for w in TRUE_WORDS)
    return f"(lower(trim(cast({value} as string))) IN ({words}))"


def mean_of_csv(value: str) -> str:
    """Mean of comma-packed whole numbers, null as soon as one part is not a whole number."""
    parts = f"filter(transform(split({value}, ','), part -> trim(part)), part -> part <> '')"
    total = "aggregate(parts, 0L, (acc, part) -> acc + try_cast(part AS BIGINT))"
    mean = (
        f"CASE WHEN size(parts) > 0 AND forall(parts, part -> part RLIKE r'{INT_TEXT}') "
        f"THEN {exact_round(f'{total} / size(parts)', 2)} END"
    )
    return bound(parts, mean, "parts")


def share_left(remaining: str, lifetime: str) -> str:
    """Percent of a lifetime still left; null when either number is missing or zero."""
    share = exact_round("cast(l.r as double) / l.life * 100", 2)
    return bound(
        f"named_struct('r', {remaining}, 'life', {lifetime})", f"CASE WHEN l.r <> 0 AND l.life > 0 THEN {share} END", "l"
    )


def text_kind(value: str) -> str:
    """Which type a piece of text stands for: digits, then float, then truth word, then text."""
    return (
        f"CASE WHEN {value} RLIKE r'{DIGITS_TEXT}' THEN 'integer' WHEN {value} RLIKE r'{FLOAT_TEXT}' THEN 'float' "
        f"WHEN lower({value}) IN ('true', 'false') THEN 'boolean' WHEN {value} IS NOT NULL THEN 'string' END"
    )


def typed_text(value: str) -> str:
    """Struct ``(type, v_int, v_dbl, v_bool, v_str)`` with exactly one value set."""
    return bound(
        f"named_struct('kind', {text_kind(value)}, 'text', {value})",
        "named_struct('type', k.kind, "
        "'v_int', CASE WHEN k.kind = 'integer' THEN try_cast(k.text AS BIGINT) END, "
        "'v_dbl', CASE WHEN k.kind = 'float' THEN try_cast(trim(k.text) AS DOUBLE) END, "
        "'v_bool', CASE WHEN k.kind = 'boolean' THEN lower(k.text) = 'true' END, "
        "'v_str', CASE WHEN k.kind = 'string' THEN k.text END)",
        "k",
    )


def converted_text(value: str) -> str:
    """Like ``typed_text`` without truth words; empty text and ``N/A`` stay text."""
    kind = (
        f"CASE WHEN {value} RLIKE r'{INT_TEXT}' THEN 'integer' WHEN {value} RLIKE r'{FLOAT_TEXT}' THEN 'float' "
        f"WHEN {value} IS NOT NULL THEN 'string' END"
    )
    return bound(
        f"named_struct('kind', {kind}, 'text', {value})",
        "named_struct('type', k.kind, "
        "'v_int', CASE WHEN k.kind = 'integer' THEN try_cast(trim(k.text) AS BIGINT) END, "
        "'v_dbl', CASE WHEN k.kind = 'float' THEN try_cast(trim(k.text) AS DOUBLE) END, "
        "'v_str', CASE WHEN k.kind = 'string' THEN k.text END)",
        "k",
    )


# ---- VARIANT leaves -------------------------------------------------------------------------


def path_of(*keys: str) -> str:
    """JSON path from object keys, safe for keys holding dashes or dots."""
    return "$" + "".join(f'["{key}"]' for key in keys)


def get_as(value: str, kind: str, *keys: str) -> str:
    return f"try_variant_get({value}, '{path_of(*keys)}', '{kind}')"


def leaf(value: str, *keys: str) -> str:
    return get_as(value, "variant", *keys)


def leaf_text(value: str, *keys: str) -> str:
    return get_as(value, "string", *keys)


def as_object(value: str, *keys: str) -> str:
    return get_as(value, "map<string,variant>", *keys)


def is_object(value: str, *keys: str) -> str:
    """Whether a leaf is an object; none of its members is copied for that."""
    return f"({get_as(value, 'struct<>', *keys)} IS NOT NULL)"


def as_list(value: str, *keys: str) -> str:
    return get_as(value, "array<variant>", *keys)


def leaf_label(value: str) -> str:
    """Type label of a leaf; booleans are told apart before integers, the rest is text."""
    return (
        f"CASE WHEN schema_of_variant({value}) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant({value}) = 'BIGINT' "
        f"THEN 'integer' WHEN schema_of_variant({value}) RLIKE '^(DOUBLE|FLOAT|DECIMAL)' THEN 'float' "
        f"WHEN {value} IS NOT NULL AND NOT is_variant_null({value}) THEN 'string' END"
    )


def int_of_leaf(value: str) -> str:
    """Whole number of a leaf: text must be whole, numbers lose their fraction."""
    from_text = bound(get_as("x", "string"), int_of_text("n"), "n")
    return bound(value, f"CASE WHEN schema_of_variant(x) = 'STRING' THEN {from_text} ELSE {get_as('x', 'bigint')} END", "x")


def double_of_leaf(value: str, precision: int | None = None) -> str:
    number = double_of_text("n")
    return bound(get_as(value, "string"), number if precision is None else exact_round(number, precision), "n")


def truthy_leaf(value: str) -> str:
    """1 for a set value, 0 for false, zero, empty text and empty collections, null for null."""
    empty = "s IN ('false', '{}', '[]') OR coalesce(try_cast(s AS DOUBLE), 1D) = 0"
    return bound(
        value,
        "CASE WHEN x IS NULL OR is_variant_null(x) THEN cast(null as bigint) ELSE "
        + bound(
            get_as("x", "string"),
            f"CASE WHEN s = '' OR (schema_of_variant(x) <> 'STRING' AND ({empty})) THEN 0L ELSE 1L END",
            "s",
        )
        + " END",
        "x",
    )


def present(value: str) -> str:
    """Neither missing nor null nor empty."""
    return f"coalesce({value} IS NOT NULL AND NOT is_variant_null({value}) AND {get_as(value, 'string')} NOT IN ('', '{{}}', '[]'), false)"


def one_or_many(value: str, *keys: str) -> str:
    """An array as it is, a single object as an array of one; scalars and null give null."""
    single = leaf(value, *keys) if keys else value
    return f"coalesce({as_list(value, *keys)}, CASE WHEN {is_object(value, *keys)} THEN array({single}) END)"


def objects_of(value: str, *keys: str) -> str:
    """Objects of a one-or-many value; elements that are not objects are left out."""
    return f"filter({one_or_many(value, *keys)}, item -> {is_object('item')})"


def first_path(value: str, paths) -> str:
    """The first of several alternative paths that is present."""
    return f"coalesce({', '.join(leaf(value, *path) for path in paths)}, cast(null as variant))"


def first_key(value: str, keys) -> str:
    """Which of several alternative keys is present first."""
    return "CASE " + " ".join(f"WHEN {leaf(value, key)} IS NOT NULL THEN '{key}'" for key in keys) + " END"


def unwrapped_text(value: str) -> str:
    """Text of a value that is text, ``{text: …}`` or ``{result: …}``; anything else gives null."""
    return (
        f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN {get_as(value, 'string')} "
        f"ELSE coalesce({leaf_text(value, 'text')}, {leaf_text(value, 'result')}) END"
    )
