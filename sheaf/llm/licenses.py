"""Licence scans: known sentences, and rules over the order in which they come.

A text is cut into sentences, each is normalised and looked up among known
licence sentences. The identifiers found, in order, are matched against rules,
most specific first; identifiers that a rule used are gone for later ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.settle import settle

# Licence sentences, normalised (lower case, blanks between words, no punctuation at word ends).
SENTENCES = {
    "apache-licensed": "licensed under the apache license version 2.0",
    "apache-licensed-the": "licensed under the apache license version 2.0 the license",
    "apache-may-not-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-is-licensed": "this project is licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
    "the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "gpl-work-3": "this work is licensed under the gnu general public license version 3",
    "gpl-work-2": "this work is licensed under the gnu general public license version 2",
    "gpl-redistribute-3": "you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-redistribute-2": "you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "cc-by-nc-4": "licensed under cc by nc 4.0",
    "cc-by-sa-4": "licensed under cc by sa 4.0",
    "cc-by-4": "licensed under cc by 4.0",
    "cc-by-4-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2.0",
}

#: Licence and the sentences it takes, in order; the first rules win.
RULES = (
    ("Apache-2.0", ("apache-licensed-the", "apache-may-not-use", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-licensed-the", "apache-may-not-use")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-released", "mit-permission", "mit-notice")),
    ("MIT", ("mit-permission", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-licensed-the",)),
    ("MIT", ("mit-permission",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-is-licensed",)),
    ("GPL-3.0", ("gpl-work-3",)),
    ("GPL-2.0", ("gpl-work-2",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl-2",)),
)

#: What every known sentence holds one of, in any case.
HINT = "(?i)licen[sc]e|permission|redistribution|copyright|warrant"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    lower = F.translate(sentence, UPPER, LOWER)
    words = F.regexp_replace(F.regexp_replace(lower, "[^a-z0-9.]+", " "), "[.]+( |$)", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(words, " +", " ")), "licence", "license")


def sentence_ids(text: Column, table: Column) -> Column:
    """Identifiers of the known sentences in order.

    A sentence ends in ``. ! ? ; :`` and white space. One over several lines that is
    not known is looked up line by line.
    """
    parts = F.split(F.regexp_replace(text, "([.!?;:])[ \\t\\r\\n]+", "$1\x01"), "\x01")

    def known(sentence: Column) -> Column:
        return F.element_at(table, normalised(sentence))

    each = F.transform(
        parts,
        lambda part: F.when(
            ~part.contains("\n") | known(part).isNotNull(), F.array(known(part))
        ).otherwise(F.transform(F.split(part, "\n"), known)),
    )
    return F.filter(F.flatten(each), lambda x: x.isNotNull())


def wrapped_ids(text: Column, table: Column, known: list[str]) -> Column:
    """Identifiers of the known sentences in order, wherever lines and sentences end inside them.

    A known sentence begins where a line or a sentence begins and ends where one
    ends. Blank lines and comment marks normalise to nothing. Of sentences that
    begin at one place the longest counts.
    """
    lines = F.split(F.regexp_replace(text, "([.!?;:])[ \\t\\r\\n]+|\n", "$1\x01"), "\x01")
    worded = F.filter(F.transform(lines, normalised), lambda line: line != "")
    whole = F.concat(F.lit("|"), F.array_join(worded, "|"), F.lit("|"))
    longest = sorted(known, key=len, reverse=True)
    any_of = "|".join("[ |]".join(re.escape(w) for w in sentence.split(" ")) for sentence in longest)
    found = F.regexp_extract_all(whole, F.lit(f"(?<=[|])(?:{any_of})(?=[|])"), F.lit(0))
    return F.transform(found, lambda sentence: F.element_at(table, F.translate(sentence, "|", " ")))


def scan_licenses(
    docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple = RULES, wrapped: bool = False
) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses`` of every row of ``docs`` (doc_id, text).

    sentence_ids: identifiers in the order of the text, comma-joined. licenses:
    names of the rules that matched, once each, in the order of the rules. A
    rule's sentences must follow each other among the known ones; what lies
    between them in the text does not count. A null or empty text has none.
    Repeated rows each have their line; other columns are left out.

    wrapped: find sentences over several lines below a title or a copyright line
    too, and those with a sentence end inside ("v. 2.0", "Foundation; either").
    Without, lines are looked up one by one, as ``oracle_sql`` does.
    """
    by_text: dict[str, str] = {}
    for name, sentence in known.items():
        if "," in name or "|" in name or sentence in by_text:
            raise ValueError(f"sentence {name} needs a plain identifier and a text of its own")
        by_text[sentence] = name
    table = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    ids = wrapped_ids(F.col("_text"), table, list(by_text)) if wrapped and by_text else sentence_ids(F.col("_text"), table)
    found = settle(
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")),
        {"_ids": F.when(F.col("_text").rlike(HINT), ids).otherwise(F.array().cast("array<string>"))},
        ["doc_id"],
    )
    plan = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(order) + "|").alias("order")) for name, order in rules]
    )
    start = F.struct(
        F.array_join(F.transform("_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "").alias("left"),
        F.array().cast("array<string>").alias("names"),
    )

    def match(state: Column, rule: Column) -> Column:
        hit = state["left"].contains(rule["order"])
        names = F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        # a mark in place of what was used keeps its neighbours apart
        return F.struct(F.replace(state["left"], rule["order"], F.lit("/")).alias("left"), names.alias("names"))

    return found.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.when(
            F.size("_ids") > 0,
            F.array_join(F.array_distinct(F.aggregate(plan, start, match, lambda state: state["names"])), ","),
        )
        .otherwise("")
        .alias("licenses"),
    )


def oracle_sql(known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> str:
    """The same over the table ``documents`` for another engine."""
    pairs = ", ".join(f"'{sentence}': '{name}'" for name, sentence in known.items())
    plan, left, names = "", "joined", []
    steps = []
    for k, (name, order) in enumerate(rules):
        text = "|" + "||".join(order) + "|"
        steps.append(f"r{k} AS (SELECT *, replace({left}, '{text}', '/') AS left{k}, contains({left}, '{text}') AS hit{k} FROM {plan or 'base'})")
        plan, left = f"r{k}", f"left{k}"
        names.append(f"CASE WHEN hit{k} THEN '{name}' END")
    every = ", ".join(names)
    known_id = (
        "m[regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace("
        f"translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9.]+', ' ', 'g'), '[.]+( |$)', ' ', 'g'), ' +', ' ', 'g'), ' '), "
        "'licence', 'license', 'g')]"
    )
    parts = "string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""
WITH known AS (SELECT MAP {{{pairs}}} AS m),
found AS (
  SELECT doc_id, list_filter(flatten(list_transform({parts}, lambda s:
    CASE WHEN NOT contains(s, chr(10)) OR {known_id} IS NOT NULL THEN [{known_id}]
    ELSE list_transform(string_split(s, chr(10)), lambda s: {known_id}) END)), lambda x: x IS NOT NULL) AS ids
  FROM documents, known
), base AS (
  SELECT doc_id, ids, coalesce(list_aggregate(list_transform(ids, lambda x: '|' || x || '|'), 'string_agg', ''), '') AS joined FROM found
), {", ".join(steps)},
named AS (SELECT doc_id, ids, list_filter([{every}], lambda x: x IS NOT NULL) AS names FROM {plan})
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses
FROM named
"""
