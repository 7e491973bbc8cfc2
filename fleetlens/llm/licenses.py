"""License scan by diagonal voting.

Every k consecutive words of a text are hashed and joined to the places where the notices have the same k words. A
hit votes for the diagonal (place in the text minus place in the notice); a passage that follows a notice puts all
its votes on one diagonal, and a word put in or left out moves them to a neighbouring one. Neighbouring diagonals are
merged into spans, and a span counts if it covers enough of the notice's words and is not much longer than it.

Only DataFrame functions. Rows travel once, by row number, and only their hits: the texts stay where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.columns import text_of, without_overlaps

#: (label, phrase): the base labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: (label, words of a notice): what the method looks for besides. The notices that licenses ask for.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl 2 1"),
    ("lgpl", "spdx license identifier lgpl 3 0"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
K = 3
#: Diagonals this close belong to one span.
NEAR = 2
#: Share of a notice's words that a span covers, and how many times as long as the notice it may be.
COVERED, LONGEST = 0.75, 1.5
#: A word, A-Z being in lower case already; taken whole, so that nothing is tried again.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def templates(spark: SparkSession, phrases: Sequence, notices: Sequence, k: int = K) -> DataFrame:
    """A row for each k-gram of each notice: its hash, its words, where it stands. As many rows as notices have words."""
    rows = []
    for base, group in ((True, phrases), (False, notices)):
        for label, text in group:
            words = text.split()
            if len(words) < k:
                raise ValueError(f"a notice has {k} words at least: {text!r}")
            name = len({r[0] for r in rows})
            rows += [(name, label, base, len(words), i, words[i : i + k]) for i in range(len(words) - k + 1)]
    table = spark.createDataFrame(rows, "t int, label string, base boolean, t_words int, t_pos int, t_gram array<string>")
    return table.withColumn("t_hash", F.xxhash64(*[F.col("t_gram")[j] for j in range(k)]))


def scan(
    docs: DataFrame, phrases: Sequence = PHRASES, notices: Sequence = NOTICES, k: int = K, covered: float = COVERED
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans found.

    One row for each row of ``docs``, whatever its other columns; repeated rows give repeated results. A null text
    counts as empty: no words, no labels, score 0. Overlapping places of a phrase all count. score is the largest
    share of a notice's words that a verified span covers; spans are (label, first word, last word, share).
    """
    spark = docs.sparkSession
    table = templates(spark, phrases, notices, k)
    wanted = [r["t_hash"] for r in table.select("t_hash").distinct().collect()]  # fixed by the notices
    # lower() would make an ASCII k of the Kelvin sign; any other word character does in its place
    text = F.lower(F.replace(text_of(docs), F.lit("K"), F.lit("é")))
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].alias("doc_id"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    # at the last k - 1 words the k-gram runs over the end; such hashes meet no row of the table, whose words are k
    rolling = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, k)]))
    hashed = words.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), rolling.alias("hashes"))
    places = F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))), lambda g: g["hash"].isin(wanted))
    rolled = hashed.select(
        "row", "doc_id", "words", "n_words",
        F.when(F.arrays_overlap("hashes", F.array(*map(F.lit, wanted))), places).alias("grams"),
    )
    found = rolled.select("row", "doc_id", "n_words", "words", F.explode_outer("grams").alias("g")).select(
        "row", "doc_id", "n_words", F.col("g.pos").alias("pos"), F.col("g.hash").alias("hash"),
        F.when(F.col("g").isNotNull(), F.slice("words", F.col("g.pos") + 1, k)).alias("gram"),
    )
    hits = (
        found.join(F.broadcast(table), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
        .select("row", "doc_id", "n_words", "t", "label", "base", "t_words", "pos", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .repartition("row")
    )
    keys = ("row", "doc_id", "n_words", "t", "label", "base", "t_words")
    votes = hits.groupBy(*keys, "diagonal").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("seen")
    )
    apart = "diagonal - lag(diagonal) over (partition by row, t order by diagonal)"
    numbered = votes.selectExpr("*", f"coalesce(cast({apart} > {NEAR} as int), 0) as cut").selectExpr(
        "*", "sum(cut) over (partition by row, t order by diagonal) as span"
    )
    spans = numbered.groupBy(*keys, "span").agg(
        F.min("first").alias("first"),
        (F.max("last") + (k - 1)).alias("last"),
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
        F.collect_list(F.when(F.size("seen") == F.col("t_words") - (k - 1), F.col("diagonal"))).alias("whole"),
    )
    share = F.size(
        F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + (k - 1)))))
    ) / F.col("t_words")
    short = (F.col("last") - F.col("first") + 1) <= F.col("t_words") * F.lit(LONGEST)
    judged = spans.withColumn("share", share).withColumn(
        "good", F.coalesce(F.when(F.col("base"), F.size("whole") > 0).otherwise((F.col("share") >= covered) & short), F.lit(False))
    )
    # a notice that overlaps a better one is dropped: one met word by word is better than one met with words put in or left
    # out, then the larger share, then the longer notice; base phrases always stay
    within = "over (partition by row, good, base order by first, last, t"
    found = judged.selectExpr(
        "*", f"max(last) {within} rows between unbounded preceding and 1 preceding) as before"
    ).selectExpr("*", f"sum(coalesce(cast(first > before as int), 0)) {within}) as place")
    chain = (
        "array_sort(collect_list(if(good and not base, struct(if(size(whole) > 0, 0, 1) as loose, -share as less, -t_words as shorter, "
        "first, t, span, last), null)) "
    )
    best = found.selectExpr("*", chain + "over (partition by row, good, base, place)) as chain").withColumn(
        "good", F.col("good") & (F.col("base") | F.exists(
            without_overlaps(F.col("chain")), lambda s: (s["t"] == F.col("t")) & (s["span"] == F.col("span"))
        )),
    )
    base = F.col("base") & F.col("good")
    total = best.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.size("whole"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.array_min("whole"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.array_max("whole"))).cast("long").alias("last_word"),
        _joined(F.when(base, F.col("label"))).alias("base_labels"),
        _joined(F.when(F.col("good"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.when(base, 1.0).otherwise(F.col("share")))), F.lit(0.0)).alias("score"),
        F.array_sort(
            F.collect_list(F.when(F.col("good"), F.struct("first", "last", "label", "share")))
        ).alias("spans"),
    )
    return total.drop("row")


def _joined(label):
    return F.array_join(F.sort_array(F.collect_set(label)), ",")
