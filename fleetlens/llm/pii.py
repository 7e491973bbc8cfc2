"""Personal data: strict patterns, and candidates judged by boosted trees.

Four base kinds are found by their patterns and checks. Besides, generators with high recall propose spans that may
overlap, and boosted trees score them by format (lengths, digits, letters, separators) and context (the characters
around). The trees learn from what anchors say about the candidates of the same corpus: an address that ends like a domain, its signs
written out or not, numbers that pass their check or are written like national ones, a token that is assigned to a name
of a secret or has the format of a known kind of key. Anchors are not features, so a
candidate without one is judged by its likeness to those that have it. For each generator the threshold is the lowest
at which the anchored share of all it selects is still ``PRECISE``; what does not reach that selects nothing. Anchored
candidates themselves are selected whatever their score, so look-alikes in the corpus do not hide them.

Only DataFrame functions. A text is searched where it is read; what travels is one row for each match, and one for each
text without any. Patterns take runs of characters whole, so that no text makes them try again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import boosting
from fleetlens.llm.columns import text_of, without_overlaps

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Base kinds: where a run of characters may start, then the run taken whole.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of candidates: kind of what they select, pattern.
GENERATORS = {
    "address": ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++(?:@| ?[\[(] ?at ?[\])] ?){DOMAIN}++(?:(?:\.| ?[\[(] ?dot ?[\])] ?){DOMAIN}++)++"),
    "dotted": ("ip", r"(?<![0-9.])[0-9]{1,9}+(?:\.[0-9]{1,9}+){3}+(?![0-9.])"),
    "number": ("card", r"(?<![0-9])[0-9](?:[ .-]?[0-9]){8,}+"),
    "call": ("phone", r"(?:\+[0-9]|\([0-9]|(?<![0-9])00[ (.-])[ ().0-9-]{6,24}[0-9](?![0-9])"),
    "token": ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"),
}
#: Context before a token that names a secret and assigns it.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"
#: Formats of keys that are secrets wherever they stand. Prefixes that issuers document.
KEYS = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^AIza[A-Za-z0-9_-]{35}$|^xox[abprs]-[A-Za-z0-9-]{16,}$|^sk_live_[A-Za-z0-9]{16,}$"
#: Characters of context that a candidate is judged by.
AROUND = 24
PRECISE = 0.9


def _matches(docs: DataFrame) -> DataFrame:
    """row, doc_id and a match of a pattern: which one, its place among them, the gap before it, the characters around."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    at = text.contains("@")
    near_at = at | text.rlike(r"[\[(] ?at ?[\])]")
    plan = [(name, p, at if name == "email" else digit) for name, p in BASE.items()]
    plan += [(name, p, near_at if name == "address" else digit) for name, (_, p) in GENERATORS.items()]
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")
    )
    held = read.select("*", *[F.when(gate, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"m_{n}") for n, p, gate in plan])
    gaps = held.select("*", *[F.when(F.size(f"m_{n}") > 0, F.split(text, p, -1)).alias(f"g_{n}") for n, p, _ in plan])

    def each(name: str, number: int) -> Column:
        m, g = F.col(f"m_{name}"), F.col(f"g_{name}")
        one = F.transform(
            m, lambda found, i: F.struct(
                F.lit(number).alias("pattern"), i.alias("place"), F.length(F.get(g, i)).alias("gap"), found.alias("match"),
                F.right(F.get(g, i), F.lit(AROUND)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after"),
            ),
        )
        return F.when(g.isNotNull(), one).otherwise(F.array().cast("array<struct<pattern:int,place:int,gap:int,match:string,before:string,after:string>>"))

    every = F.concat(*[each(n, i) for i, (n, _, _) in enumerate(plan)])
    return gaps.select("row", "doc_id", F.explode_outer(every).alias("m")).select("row", "doc_id", "m.*")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits pass the check; doubling every second one from the right."""
    numbers = F.transform(
        F.split(F.reverse(_digits(match)), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x) % 10 == 0


def _octets(match: Column) -> Column:
    """Whether all parts are 255 at most, whatever zeros they begin with."""
    return F.forall(
        F.split(match, r"\."),
        lambda p: p.rlike(r"^0*+[0-9]{0,3}$") & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255),
    )


def _valid(name: str, match: Column) -> Column:
    n = F.length(_digits(match))
    return {
        "email": F.lit(True),
        "ip": _octets(match),
        "card": n.between(12, 19) & _luhn(match),
        "phone": n.between(9, 15),
        # written out, both signs are: name [at] host [dot] com
        "address": match.rlike(r"\.[A-Za-z]{2,}$") & match.contains("@") | match.rlike(r"[\[(] ?at ?[\])].*[\[(] ?dot ?[\])] ?[A-Za-z]{2,}$"),
        "dotted": _octets(match),
        "number": n.between(12, 19) & _luhn(match),
        # without a plus: a code in brackets that begins with 0, or 00 and a country
        "call": n.between(9, 15) & (match.startswith("+") | match.rlike(r"^\(0[0-9]{1,5}\)[ -]?[0-9]") | match.rlike(r"^00[ -][1-9]")),
        "token": F.col("before").rlike(ASSIGNED) | match.rlike(KEYS),
    }[name]


def _class(char: Column) -> Column:
    """0 nothing, 1 white space, 2 quotes, 3 brackets, 4 = and :, 5 digits, 6 letters, 7 others."""
    out = F.lit(7)
    for value, pattern in ((6, r"\p{L}"), (5, "[0-9]"), (4, "[=:]"), (3, r"[()\[\]{}<>]"), (2, "[\"'`]"), (1, r"\s")):
        out = F.when(char.rlike(pattern), value).otherwise(out)
    return F.when(F.coalesce(char, F.lit("")) == "", 0).otherwise(out)


def _bin(n: Column, *limits: int) -> Column:
    out = F.lit(len(limits))
    for i, most in reversed(list(enumerate(limits))):
        out = F.when(n <= most, i).otherwise(out)
    return out


def _featured(matches: DataFrame) -> DataFrame:
    match = F.col("match")
    n = F.length(_digits(match))
    return matches.select(
        "*", (F.col("pattern") - len(BASE)).alias("generator"),
        _bin(n, 0, 8, 11, 12, 13, 14, 15, 16, 17, 18, 19).alias("digits"),
        _bin(F.length(F.regexp_replace(match, "[^A-Za-z]", "")), 0, 2, 5, 12, 19).alias("letters"),
        match.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int").alias("hexadecimal"),
        _bin(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), 0, 1, 3).alias("separators"),
        _class(F.right("before", F.lit(1))).alias("prior"), _class(F.col("after")).alias("next"),
        _bin(F.length(match), 12, 19, 24, 31, 32, 39, 40, 63, 64).alias("size"),
    )


#: The features, all of them small numbers.
COLUMNS = ("generator", "digits", "letters", "hexadecimal", "separators", "prior", "next", "size")


def train(docs: DataFrame) -> tuple[boosting.Boosted, dict[str, float]]:
    """Trees, and the threshold of each generator, from all candidates of all texts.

    What reaches the driver is a row for each combination of feature values; their number is bound by the bins.
    """
    matches = _matches(docs).filter(F.col("pattern") >= len(BASE))
    anchored = F.lit(False)
    for i, name in enumerate(GENERATORS):
        anchored = F.when(F.col("pattern") == len(BASE) + i, _valid(name, F.col("match"))).otherwise(anchored)
    counts = _featured(matches).groupBy(*COLUMNS).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(anchored, F.lit(False)).cast("int")).alias("positive")
    )
    rows = sorted(counts.collect(), key=lambda r: tuple(r[c] for c in COLUMNS))
    cells = [boosting.Cell({c: r[c] for c in COLUMNS}, r["n"], r["positive"]) for r in rows]
    model = boosting.fit(cells)
    least = {
        name: boosting.threshold(model, [c for c in cells if c.values["generator"] == i], PRECISE)
        for i, name in enumerate(GENERATORS)
    }
    return model, least


def find(docs: DataFrame, model: boosting.Boosted, least: dict[str, float]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and found, one row for each row of ``docs``.

    Base spans always stay. A selected candidate is left out only if it overlaps a base span or a candidate that stays and
    scores higher, or scores the same and starts earlier or is longer. found has
    kind, start, end and the text of each span; places are code points, ends exclusive. A null text counts as empty;
    other columns are left out; repeated rows give repeated results.
    """
    kinds = [*BASE, *[kind for kind, _ in GENERATORS.values()]]
    matches = _featured(_matches(docs)).withColumn("score", model.column()).repartition("row")
    match = F.col("match")
    kind, chosen = F.lit(None).cast("int"), F.lit(False)
    for i, name in enumerate([*BASE, *GENERATORS]):
        own = F.col("pattern") == i
        kind = F.when(own, KINDS.index(kinds[i])).otherwise(kind)
        limit = least.get(name, 0.0)
        good = _valid(name, match)  # an anchored candidate stays whatever its score
        if name in GENERATORS and limit < float("inf"):
            good = F.coalesce(good, F.lit(False)) | (F.col("score") >= limit)
        chosen = F.when(own, good).otherwise(chosen)
    size = F.length(match)
    placed = (
        matches.withColumn("size", size).withColumn("kind", kind).withColumn("base", F.col("pattern") < len(BASE))
        .selectExpr("*", "sum(gap + size) over (partition by row, pattern order by place) as stop")
        .select("row", "doc_id", "pattern", "place", "kind", "base", "score", "match", (F.col("stop") - F.col("size")).alias("start"), "stop", F.coalesce(chosen, F.lit(False)).alias("chosen"))
    )
    order = "over (partition by row, chosen order by start, stop, pattern"
    islands = placed.selectExpr(
        "*", f"max(stop) {order} rows between unbounded preceding and 1 preceding) as reached"
    ).selectExpr("*", f"sum(coalesce(cast(start >= reached as int), 0)) {order}) as island")
    chain = (
        "array_sort(collect_list(if(chosen, struct(not base as found, -score as less, start as first, -stop as shorter, pattern, place, "
        "stop - 1 as last), null)) "
        "over (partition by row, chosen, island))"
    )
    ranked = islands.selectExpr("*", f"{chain} as chain")
    stays = F.col("chosen") & (F.col("base") | F.exists(
        without_overlaps(F.col("chain")), lambda s: (s["pattern"] == F.col("pattern")) & (s["place"] == F.col("place"))
    ))
    span = F.struct("start", "kind", "stop", "match")
    base = stays & F.col("base")
    total = ranked.groupBy("row", "doc_id").agg(
        *[F.count(F.when(base & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.array_sort(F.collect_list(F.when(base, span))).alias("strict"),
        F.array_sort(F.collect_list(F.when(stays, span))).alias("all"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def told(spans: str) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(one, ",")

    return total.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(told("strict"), 256).alias("base_sha256"), told("all").alias("spans"),
        F.transform("all", lambda s: F.struct(
            F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("end"), s["match"].alias("text")
        )).alias("found"),
    )
