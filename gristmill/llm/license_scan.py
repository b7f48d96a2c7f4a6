"""License scans: known phrases, and diagonal voting against license templates.

Words are numbered from 0.  All rolling runs of ``GRAM`` words are hashed and joined with the
positions of the templates' runs; a hit of text position p on template position t votes for
the diagonal p - t.  Votes are summed for each text, template and diagonal.  Words put in or left out
shift what follows, so neighbouring diagonals are merged: they are laid in bins, twice with
bins half a width apart, so that all within half a width meet in one bin, and none further apart than
a whole one do.

A merged span with enough votes is verified word by word.  The words that its votes stand for are
laid out in order, each as one character, others as a blank; the edit distance between that and
the template, whole, must leave ``COVERAGE`` of the template's words, and the run that tells the template
from its relatives must be there.  So both order and length count: the same runs shuffled or
repeated are no license.  The score is the best share of a template that stands in the text, 1 for
a base phrase, 0 if nothing is verified.

The templates, short notices and whole licenses, are constants, so the join's other side has a
fixed size and is broadcast; the texts' words are never shuffled.  Of a text without hits one row goes on,
with its number of words.  All of it is DataFrame functions.

Null and empty texts have no words, no labels (empty strings) and score 0.  Every row gets a
result of its own, rows that repeat a doc_id too; a null doc_id stays null.  Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

GRAM, COVERAGE = 3, 0.75
#: Diagonals of a bin for a template of n words: 2 * (SLACK + n / SLACK_SHARE).
SLACK, SLACK_SHARE = 3, 8
#: Share of a template's runs that a span is verified for; an edit may break GRAM of them.
CANDIDATE = 0.4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of consecutive words, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, words, and the run without which the text isn't this license.
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "hereby granted free"),
    ("apache-2", "licensed under the apache license version 2 0", "license version 2"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "license version 2"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary"),
    ("bsd", "licensed under the bsd license", "the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "by sa 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "commons attribution noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "merge publish distribute"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "with or without"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "source and binary"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution", "must be plainly"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "either version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "either version 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered"),
]


def words(text: str = "text") -> Column:
    """Words of the text with A-Z as a-z.

    ``lower`` may change other letters as well; none of them becomes a-z but the Kelvin sign,
    which is taken out first, so words of a-z and digits are the same as with A-Z alone.
    """
    return F.regexp_extract_all(F.lower(F.replace(_spark.empty_text(text), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), 0)


def _gram_hash(*w: Column) -> Column:
    return F.xxhash64(*w)


def _templates(documents: DataFrame) -> DataFrame:
    """gm_hash and all places of that run in templates: template number and position."""
    rows = [(n, t, w[t : t + GRAM]) for n, (_, text, _) in enumerate(TEMPLATES) for w in [text.split()] for t in range(len(w) - GRAM + 1)]
    grams = documents.sparkSession.createDataFrame(rows, "n int, t int, w array<string>")
    h = _gram_hash(*[F.col("w")[i] for i in range(GRAM)])
    return grams.groupBy(h.alias("gm_hash")).agg(F.collect_list(F.struct("n", "t")).alias("gm_places"))


def _letters() -> dict[str, str]:
    """A character for each word of the templates."""
    return {w: chr(0x4E00 + i) for i, w in enumerate(sorted({w for _, text, _ in TEMPLATES for w in text.split()}))}


def _facts() -> Column:
    """By a template's number: its label, words, runs, words as characters, the place of its telling run, and the width of its bins."""
    letter = _letters()
    kinds = (("label", str), ("words", int), ("runs", int), ("letters", str), ("must", int), ("width", int))
    rows = []
    for label, text, must in TEMPLATES:
        w = text.split()
        rows.append((label, len(w), len(w) - GRAM + 1, "".join(letter[x] for x in w), _place(text, must), 2 * (SLACK + len(w) // SLACK_SHARE)))
    return F.create_map(*[x for i, row in enumerate(rows) for x in (F.lit(i), F.struct(*[F.lit(v).alias(name) for v, (name, _) in zip(row, kinds)]))])


def _share(votes: Column, fact: Column) -> Column:
    """How much of the template stands in a span, from 0 to 1: one less the edit distance by the template's words."""
    known = F.map_from_entries(F.array_distinct(F.flatten(F.transform(votes, lambda v: F.transform(F.sequence(F.lit(0), F.lit(GRAM - 1)), lambda j: F.struct(v["p"] + j, F.substr(fact["letters"], v["t"] + j + 1, F.lit(1))))))))
    first, last = F.array_min(F.map_keys(known)), F.array_max(F.map_keys(known))
    laid = F.array_join(F.transform(F.sequence(first, last), lambda i: F.coalesce(F.element_at(known, i), F.lit(" "))), "")
    # the distance is at most the longer one's length
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(laid, fact["letters"]) / fact["words"])


def _base_label() -> Column:
    """The label of the phrase that begins at this word."""
    out = F.lit(None).cast("string")
    for phrase, label in BASE.items():
        found = F.lit(True)
        for i, w in enumerate(phrase.split()):
            found = found & (F.col(f"gm_w.{i}") == w)
        out = F.when(found, label).otherwise(out)
    return out


def scan(documents: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    width = max(GRAM, *(len(p.split()) for p in BASE))
    docs = documents.select("doc_id", F.monotonically_increasing_id().alias("gm_row"), words().alias("gm_words"))
    n = F.size("gm_words")
    shifted = [F.when(n > i, F.slice("gm_words", F.lit(i + 1), F.greatest(n - i, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias(str(i)) for i in range(width)]
    each = docs.select("doc_id", "gm_row", n.cast("long").alias("gm_n"), F.posexplode_outer(F.arrays_zip(*shifted)).alias("gm_at", "gm_w"))
    each = each.select("doc_id", "gm_row", "gm_n", "gm_at", _base_label().alias("gm_base"), _gram_hash(*[F.col(f"gm_w.{i}") for i in range(GRAM)]).alias("gm_hash"))
    hits = each.join(F.broadcast(_templates(documents)), "gm_hash", "left").where("gm_at is null or gm_at = 0 or gm_base is not null or gm_places is not null")

    # a row for each vote; what belongs to the word and not to the vote stands on the first only
    votes = hits.select("doc_id", "gm_row", "gm_n", "gm_at", "gm_base", F.posexplode_outer("gm_places").alias("gm_k", "gm_place"))
    lead = F.coalesce(F.col("gm_k"), F.lit(0)) == 0
    base = F.when(lead & F.col("gm_base").isNotNull(), F.col("gm_at"))
    diagonals = votes.groupBy("gm_row", "doc_id", "gm_n", F.col("gm_place.n").alias("gm_t"), (F.col("gm_at") - F.col("gm_place.t")).alias("gm_d")).agg(
        F.collect_set("gm_place.t").alias("gm_ts"),
        F.count(base).alias("gm_bases"),
        F.min(base).alias("gm_first"),
        F.max(base).alias("gm_last"),
        F.collect_set(F.when(lead, F.col("gm_base"))).alias("gm_labels"),
    )
    fact = F.element_at(_facts(), F.col("gm_t"))
    # twice, with bins half a width apart; what doesn't belong to votes is in the first only
    twice = diagonals.withColumn("gm_half", F.explode(F.when(F.col("gm_t").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    bin_ = F.floor((F.col("gm_d") + F.col("gm_half") * fact["width"] / 2) / fact["width"])
    once = F.col("gm_half") == 0
    merged = twice.groupBy("gm_row", "doc_id", "gm_n", "gm_t", "gm_half", bin_.alias("gm_bin")).agg(
        F.flatten(F.collect_list(F.transform("gm_ts", lambda t: F.struct((t + F.col("gm_d")).alias("p"), t.alias("t"))))).alias("gm_votes"),
        F.sum(F.when(once, F.col("gm_bases"))).alias("gm_bases"),
        F.min(F.when(once, F.col("gm_first"))).alias("gm_first"),
        F.max(F.when(once, F.col("gm_last"))).alias("gm_last"),
        F.flatten(F.collect_list(F.when(once, F.col("gm_labels")).otherwise(F.array().cast("array<string>")))).alias("gm_labels"),
    )
    ts = F.array_distinct(F.transform("gm_votes", lambda v: v["t"]))
    worth = F.col("gm_t").isNotNull() & (F.size(ts) >= CANDIDATE * fact["runs"]) & F.array_contains(ts, fact["must"])
    share = F.when(worth, _share(F.col("gm_votes"), fact)).otherwise(F.lit(0.0))
    merged = merged.withColumn("gm_share", share)
    verified = F.col("gm_share") >= coverage
    found = merged.groupBy("gm_row", "doc_id", "gm_n").agg(
        F.coalesce(F.sum("gm_bases"), F.lit(0)).alias("gm_bases"),
        F.min("gm_first").cast("long").alias("gm_first"),
        F.max("gm_last").cast("long").alias("gm_last"),
        F.array_distinct(F.flatten(F.collect_list("gm_labels"))).alias("gm_labels"),
        F.collect_set(F.when(verified, fact["label"])).alias("gm_more"),
        F.max(F.when(verified, F.col("gm_share")).otherwise(F.lit(0.0))).alias("gm_share"),
    )
    text_of = lambda a: F.concat_ws(",", F.array_sort(a))
    return found.select(
        "doc_id",
        F.col("gm_n").alias("n_words"),
        F.col("gm_bases").alias("n_base"),
        F.col("gm_first").alias("first_word"),
        F.col("gm_last").alias("last_word"),
        text_of(F.col("gm_labels")).alias("base_labels"),
        text_of(F.array_union("gm_labels", "gm_more")).alias("labels"),
        F.when(F.col("gm_bases") > 0, 1.0).otherwise(F.col("gm_share")).alias("score"),
    )


def _place(text: str, run: str) -> int:
    w, r = text.split(), run.split()
    return next(t for t in range(len(w)) if w[t : t + len(r)] == r)
