"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, sentences are normalised (lower case, every run of other characters than letters, digits and
dots is one blank) and looked up in a catalogue of known licence sentences. The text becomes a sequence of identifiers in
which unknown sentences are gaps. Ordered rules, each a run of adjacent identifiers, are tried one after the other; what a
rule matches is used up, so full licence texts come before the short references they hold.

Sentences end after ``. ! ? ;`` before white space, after ``:`` at a line break and at blank lines (marks of comments count
as blank). Other line breaks are read in two ways, place by place: a piece that is known with its lines joined counts as one
sentence; otherwise its last lines may be one below a title, and the lines left stand for themselves. Numbers and letters
that count list items and pieces without letters or digits are left out. Null and empty texts have no sentences. Rows are
independent: no shuffle, no group, no effect of repeated rows or other columns. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import fresh_name, quoted, text_or_empty

# Known sentences by identifier. The texts are those of the public licences.
SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as_is_mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "liability_mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit_ref": "Released under the MIT License.",
    "mit_ref_licensed": "Licensed under the MIT License.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache_ref": "Licensed under the Apache License, Version 2.0.",
    "apache_head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_comply": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "gpl3_ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_later": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_terms": "it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2_later": "either version 2 of the License, or (at your option) any later version.",
    "free_software": "This program is free software;",
    "gpl3_program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3_may": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_may": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl_details": "See the GNU General Public License for more details.",
    "mpl_ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "cc_by_nc_ref": "Licensed under CC BY-NC 4.0.",
    "cc_by_ref": "Licensed under CC BY 4.0.",
    "cc_by_sa_ref": "Licensed under CC BY-SA 4.0.",
    "cc0_ref": "Licensed under CC0 1.0.",
    "all_rights": "All rights reserved.",
}
# Licences with the sentences that show them, in the order in which rules are tried.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is_mit", "liability_mit")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_head", "apache_comply", "apache_copy")),
    ("Apache-2.0", ("apache_head",)),
    ("Apache-2.0", ("apache_ref",)),
    ("GPL-3.0-or-later", ("gpl3_program",)),
    ("GPL-3.0-or-later", ("free_software", "gpl3_may")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("free_software", "gpl2_may", "gpl2_later")),
    ("GPL-2.0-or-later", ("gpl_terms", "gpl2_later")),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("MPL-2.0", ("mpl_ref",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_ref",)),
    ("CC-BY-4.0", ("cc_by_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_ref_licensed",)),
)
LICENCES = tuple(dict.fromkeys(name for name, _ in RULES))

#: A text without any of these can't hold a known sentence (a test holds the catalogue to it).
ANCHORS = ("licens", "copyright", "permission", "warrant", "redistribut", "liable", "rights reserved", "free software", "gnu general public")
END = r"(?<=[.!?;])\s+|(?<=:)\s*\n\s*|\n[ \t\r\f\x0B*#/;%-]*\n\s*"
LINES = r"\n"
#: What counts a list item: "1." before white space, "(a)", "2)".
LABEL = r"^[^A-Za-z0-9]*([0-9]{1,2}|[A-Za-z])[.)](\s+|$)"
GAP = "~"


def spdx(name: str) -> str:
    return f"spdx license identifier {name.lower().replace('-', ' ')}"


def normalised(sentence: str) -> str:
    """The normal form of one sentence, as the column expression gives it."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in sentence.lower())
    return " ".join(kept.split()).rstrip(". ")


def catalogue() -> dict[str, str]:
    """Normal sentence to identifier; tags of the form of SPDX are added for every licence that the rules know."""
    return {normalised(t): i for i, t in SENTENCES.items()} | {spdx(n): f"spdx_{n}" for n in LICENCES}


def rules() -> list[tuple[str, tuple[str, ...]]]:
    return [*RULES, *((n, (f"spdx_{n}",)) for n in LICENCES)]


def longest() -> int:
    """Words of the longest known sentence, and so the most lines that can hold one."""
    return max(len(s.split()) for s in catalogue())


def _normal(sentence: Column) -> Column:
    sentence = F.regexp_replace(sentence, LABEL, "")
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")), "[. ]+$", "")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with the licences of each row.

    ``licences`` are the matched rules' licences, each once, in rule order; ``license_sentences`` the identifiers met, in
    text order; ``unmatched`` counts those that no rule used up.
    """
    keep = docs.columns if keep is None else keep
    whole = text_or_empty(quoted(text))
    names = F.create_map(*(F.lit(x) for pair in catalogue().items() for x in pair))
    none, most = F.array().cast("array<string>"), longest()

    known_as = lambda normal: F.try_element_at(names, normal)
    singly = lambda lines: F.transform(lines, lambda n: F.coalesce(known_as(n), F.lit(GAP)))
    cut = lambda piece, pattern: F.filter(F.transform(F.split(piece, pattern, -1), _normal), lambda n: n != "")

    def below_title(lines: Column) -> Column:
        """Line by line, but the last lines as one sentence if they are known as one (the longest such run)."""
        first = F.greatest(F.lit(2), F.size(lines) - most + 1)
        tails = F.when(F.size(lines) > 2, F.transform(F.sequence(first, F.size(lines) - 1), lambda i: F.struct(i.alias("at"), known_as(F.array_join(F.slice(lines, i, most), " ")).alias("id"))))
        best = F.try_element_at(F.filter(tails, lambda t: t["id"].isNotNull()), F.lit(1))
        return F.when(best.isNull(), singly(lines)).otherwise(F.concat(singly(F.slice(lines, 1, best["at"] - 1)), F.array(best["id"])))

    def read_piece(piece: Column) -> Column:
        one = known_as(_normal(piece))
        return F.when(one.isNotNull(), F.array(one)).when(~F.contains(piece, F.lit("\n")), singly(F.filter(F.array(_normal(piece)), lambda n: n != ""))).otherwise(F.flatten(F.transform(F.array(cut(piece, LINES)), below_title)))

    known = lambda ids: F.filter(ids, lambda i: i != GAP)
    may = F.lower(whole).rlike("|".join(ANCHORS))
    out = fresh_name(docs, "_ids")
    read = F.flatten(F.transform(F.split(whole, END, -1), read_piece))
    found = docs.withColumn(out, F.coalesce(F.when(may, read), none))
    ids = F.col(out)
    start = F.struct(F.concat(F.lit("/"), F.array_join(ids, "//"), F.lit("/")).alias("left"), none.alias("hits"))

    def attempt(state: Column, rule: Column) -> Column:
        """Use up every run of the rule; a gap keeps the neighbours of what was cut apart."""
        hit = F.contains(state["left"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["run"], F.lit(f"/{GAP}/"))).otherwise(state["left"]).alias("left"),
            F.when(hit & ~F.array_contains(state["hits"], rule["name"]), F.concat(state["hits"], F.array(rule["name"]))).otherwise(state["hits"]).alias("hits"),
        )

    ordered = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f"/{'//'.join(run)}/").alias("run")) for n, run in rules()))
    done = F.when(F.size(known(ids)) > 0, F.aggregate(ordered, start, attempt))
    kept = found.select(*map(quoted, keep), ids.alias(out), done.alias(out + "_done"))
    done, ids = F.col(out + "_done"), F.col(out)
    rest = F.filter(F.split(done["left"], "/"), lambda i: (i != "") & (i != GAP))
    fresh = [fresh_name(docs.select(*map(quoted, keep)), n) for n in ("licences", "license_sentences", "unmatched")]
    return kept.select(
        *map(quoted, keep),
        F.coalesce(done["hits"], none).alias(fresh[0]),
        known(ids).alias(fresh[1]),
        F.coalesce(F.size(rest), F.lit(0)).cast("long").alias(fresh[2]),
    )


def sequence_matches(ids: list[str]) -> tuple[list[str], int]:
    """The rule step on one identifier sequence (gaps as ``~``), for checks on a few texts."""
    text = "/" + "//".join(ids) + "/"

    def attempt(state: tuple[str, list[str]], rule: tuple[str, tuple[str, ...]]) -> tuple[str, list[str]]:
        left, hits = state
        run = f"/{'//'.join(rule[1])}/"
        if run in left:
            left, hits = left.replace(run, f"/{GAP}/"), hits if rule[0] in hits else [*hits, rule[0]]
        return left, hits

    left, hits = reduce(attempt, rules(), (text, []))
    return hits, sum(i not in ("", GAP) for i in left.split("/"))
