"""Licence scans: a positional rare-token index over licence templates. DataFrame operations only.

Document frequencies of the templates' words are counted over the whole corpus. Wherever a template's key phrases stand, its
key words of highest IDF are among the file's licence words of highest IDF; so a template is filed under the two of them,
with their places, and all places of such words in a file are looked up. Each posting gives a (template, start), start
being where the template would begin. Starts on which the postings of both words agree are kept, compared word by word with
the template, and given its label if all its mandatory key phrases stand in their places.

Real files add names, leave out list numbers or change a word. So each key phrase of a longer template is filed, looked up and
verified in the same way by itself, and a template's label is given, too, where all its phrases follow each other in
order, as far apart as in the template but for some slack.

A row is worked on by itself: no shuffle, no join. What is sent along is the index, whose size is that of TEMPLATES.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD_SEPARATORS, table


@dataclass(frozen=True)
class Template:
    """Words of a notice; `keys` are phrases of it, in order, that must stand where they do; `base` marks the contract's phrases."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    def key_places(self) -> list[tuple[int, list[str]]]:
        """(place, words) of each key phrase: the first place after the phrase before it."""
        own, found, at = self.words(), [], 0
        for key in self.keys:
            words = re.findall("[a-z0-9]+", key.lower())
            at = next(i for i in range(at, len(own)) if own[i : i + len(words)] == words)
            found.append((at, words))
        return found


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
BSD_KEYS = ("redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""

#: The contract's phrases; whole texts of licences and notices; usual short wordings.
TEMPLATES = (
    Template("gpl", "gnu general public license", ("gnu general public license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("cc-by", "cc by", ("cc by",), True),
    Template("mit", "mit license", ("mit license",), True),
    Template("mit", MIT, ("permission is hereby granted free of charge", "this permission notice shall be included", "the software is provided as is without warranty", "in no event shall the authors or copyright holders be liable")),
    Template("isc", ISC, ("permission to use copy modify and or distribute", "this permission notice appear in all copies", "in no event shall the author be liable")),
    Template("bsd-2-clause", BSD_HEAD + BSD_TAIL, (*BSD_KEYS, "this software is provided by the copyright holders", "even if advised of the possibility")),
    Template("bsd-3-clause", BSD_HEAD + BSD_NAMES + BSD_TAIL, (*BSD_KEYS, "neither the name of", "nor the names of its contributors", "even if advised of the possibility")),
    Template("apache-2.0", APACHE, ("licensed under the apache license version 2 0", "except in compliance with the license", "unless required by applicable law", "limitations under the license")),
    Template("gpl-3.0", GPL, ("you can redistribute it and or modify it", "published by the free software foundation", "either version 3 of the license", "in the hope that it will be useful")),
    Template("zlib", ZLIB, ("in no event will the authors be held liable", "the origin of this software must not be misrepresented", "altered source versions must be plainly marked", "this notice may not be removed")),
    Template("unlicense", UNLICENSE, ("this is free and unencumbered software", "anyone is free to copy modify publish use", "commercial or non commercial")),
    Template("apache-2.0", "apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "eclipse public license v 2 0", ("eclipse public license",)),
)
#: Of an in-place template without its key phrases, the share of its IDF counts by this factor.
PARTIAL = 0.5
#: Places of a score after the point.
DIGITS = 6
#: A (template, start) is one long: the template's number above so many bits.
START_BITS = 40
#: Words that the way from one key phrase to the next may have more or less than in the template: so many, and this share of it.
SLACK, SLACK_SHARE = 12, 0.15


def tokens(text: str) -> Column:
    """Words of a whole text, A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, WORD_SEPARATORS), "")


def _listed(words) -> Column:
    """An array of words, or of numbers as texts, that is one constant of the plan."""
    return F.split(F.lit(" ".join(map(str, words))), " ")


def document_frequencies(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """In how many texts each word of the templates occurs, and under '' the number of texts. A row for each such word."""
    vocabulary = sorted({w for t in templates for w in t.words()})
    words = docs.select(F.array_intersect(_listed(vocabulary), tokens(text)).alias("own"))
    counted = words.select(F.explode(F.array_append("own", "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {"": 0} | {r.word: r.n for r in counted.collect()}


@dataclass
class Index:
    """templates: those asked for, of which there are `asked`, then the key phrases of longer ones, each as a template.

    first and second: of the two rarest words of each template's key phrases, word -> [(template, place)]. idf: by word. chains: for
    each longer template its number and its phrases' (number, place), in order.
    """

    templates: tuple[Template, ...]
    asked: int
    first: dict[str, list[tuple[int, int]]]
    second: dict[str, list[tuple[int, int]]]
    idf: dict[str, float]
    chains: list[tuple[int, list[tuple[int, int]]]]


def with_phrases(templates=TEMPLATES) -> tuple[tuple[Template, ...], list[tuple[int, list[tuple[int, int]]]]]:
    """The templates and the key phrases of those that have several, and the chains of an Index."""
    every, numbers, chains = list(templates), {}, []
    for number, template in enumerate(templates):
        if len(template.keys) > 1:
            chain = []
            for at, words in template.key_places():
                phrase = " ".join(words)
                if phrase not in numbers:
                    numbers[phrase] = len(every)
                    every.append(Template("", phrase, (phrase,)))
                chain.append((numbers[phrase], at))
            chains.append((number, chain))
    return tuple(every), chains


def way(chain: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """The least and the most words from the start of a chain's k-th phrase to that of the next."""
    apart = chain[k + 1][1] - chain[k][1]
    slack = SLACK + int(SLACK_SHARE * apart)
    return max(1, apart - slack), apart + slack


def build_index(frequencies: dict[str, int], templates=TEMPLATES) -> Index:
    """Ties of IDF go to the word that comes first by code points. A template of one word is filed under it twice."""
    idf = {w: log((frequencies[""] + 1) / (frequencies.get(w, 0) + 1)) + 1 for t in templates for w in t.words()}
    first: dict[str, list[tuple[int, int]]] = {}
    second: dict[str, list[tuple[int, int]]] = {}
    every, chains = with_phrases(templates)
    for number, template in enumerate(every):
        # Of the key phrases only: a place where these stand cannot be missed for want of another word.
        place = {w: at + i for at, words in reversed(template.key_places()) for i, w in reversed(list(enumerate(words)))}
        ranked = sorted(place, key=lambda w: (-idf[w], w))
        for filed, word in ((first, ranked[0]), (second, ranked[min(1, len(ranked) - 1)])):
            filed.setdefault(word, []).append((number, place[word]))
    return Index(every, len(templates), first, second, idf, chains)


def _starts(words: Column, filed: dict[str, list[tuple[int, int]]]) -> Column:
    """Coded (template, start) of every posting of every word of `words` that `filed` has."""
    # A map's entry is template << START_BITS minus the place, so that adding a word's place gives the code.
    codes = F.create_map(*[x for w, posts in sorted(filed.items()) for x in (F.lit(w), F.array(*[F.lit((number << START_BITS) - place) for number, place in posts]))])
    rare = sorted(filed)
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    return F.flatten(F.transform(places, lambda i: F.transform(codes[F.element_at(words, i + 1)], lambda code: code + i)))


def matches(words: Column, index: Index) -> Column:
    """Array of struct(template, start, share, verified): every place where both rarest words of a template, or of a phrase, agree.

    share is the part of the template's IDF whose words stand in place; verified says that its key phrases do.
    """
    coded = F.when(F.arrays_overlap(words, F.array(*map(F.lit, sorted(index.first)))), F.array_intersect(_starts(words, index.first), _starts(words, index.second)))
    none = F.array().cast("array<bigint>")
    # A start before the text's first word borrows from the template's number: such codes are not whole places.
    half = 1 << (START_BITS - 1)

    def template_of(code):
        return F.shiftright(code + F.lit(half), START_BITS).cast("int")

    found = F.transform(F.coalesce(coded, none), lambda c: F.struct(template_of(c).alias("template"), (c - F.shiftleft(template_of(c).cast("long"), START_BITS)).cast("int").alias("start")))
    found = F.filter(found, lambda m: m["start"] >= 0)
    texts = F.array(*[_listed(t.words()) for t in index.templates])
    weights = F.array(*[_listed(index.idf[w] for w in t.words()).cast("array<double>") for t in index.templates])
    keys = []
    for t in index.templates:
        keys.append(F.array(*[F.struct(F.lit(at).alias("at"), _listed(phrase).alias("words")) for at, phrase in t.key_places()]))
    keys = F.array(*keys)

    def judge(m):
        template = m["template"] + 1
        own, weight = F.element_at(texts, template), F.element_at(weights, template)
        here = F.slice(words, m["start"] + 1, F.size(own))
        got = F.aggregate(F.zip_with(F.zip_with(here, own, lambda a, b: a.eqNullSafe(b)), weight, lambda same, w: F.when(same, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
        whole = F.aggregate(weight, F.lit(0.0), lambda acc, x: acc + x)
        sure = F.forall(F.element_at(keys, template), lambda k: F.slice(words, m["start"] + k["at"] + 1, F.size(k["words"])) == k["words"])
        return F.struct(m["template"].alias("template"), m["start"].cast("long").alias("start"), F.least(got / whole, F.lit(1.0)).alias("share"), sure.alias("verified"))

    return F.transform(found, judge)


def chained(words: Column, found: Column, index: Index) -> Column:
    """Array of the same structs for places where all phrases of a longer template follow each other, of what `matches` found.

    start is where the template would begin, counted back from the first phrase; share is the part of the IDF of the template's
    distinct words that occur from there to where it would end. Such places are verified.
    """
    def starts(phrase: int) -> Column:
        return F.transform(F.filter(found, lambda m: (m["template"] == phrase) & m["verified"]), lambda m: m["start"])

    def onward(ways: Column, phrase: int, low: int, high: int) -> Column:
        def from_here(w):
            return F.transform(F.filter(starts(phrase), lambda s: (s - w["at"]).between(low, high)), lambda s: F.struct(w["first"].alias("first"), s.alias("at")))

        return F.flatten(F.transform(ways, from_here))

    def places(number: int, chain: list[tuple[int, int]]) -> Column:
        ways = F.transform(starts(chain[0][0]), lambda s: F.struct(s.alias("first"), s.alias("at")))
        for k in range(len(chain) - 1):
            ways = onward(ways, chain[k + 1][0], *way(chain, k))
        own = sorted(set(index.templates[number].words()))
        vocabulary, weight = _listed(own), _listed(index.idf[w] for w in own).cast("array<double>")
        whole, last = sum(index.idf[w] for w in own), len(index.templates[number].words()) - chain[-1][1]

        def judge(w):
            start = F.greatest(w["first"] - chain[0][1], F.lit(0))
            here = F.slice(words, start.cast("int") + 1, (w["at"] - start).cast("int") + last)
            got = F.aggregate(F.zip_with(vocabulary, weight, lambda x, idf: F.when(F.array_contains(here, x), idf).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
            return F.struct(F.lit(number).alias("template"), start.cast("long").alias("start"), F.least(got / whole, F.lit(1.0)).alias("share"), F.lit(True).alias("verified"))

        return F.transform(ways, judge)

    every = [places(*x) for x in index.chains]
    return F.concat(*every) if every else F.filter(found, lambda m: F.lit(False))


def scan(docs: DataFrame, index: Index, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The `keep` columns and n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    n_base counts all places of the base phrases; first_word and last_word are their smallest and largest start, null if
    there is none. labels are those of all templates verified in place or by their chained phrases, base ones among them. score is the highest share found, of
    unverified templates by PARTIAL, to DIGITS places; 0 without any. places has the verified (label, start). Null and empty
    texts have no words. Rows are scanned each by itself, repeated ones alike, and whole, however long. Columns of `keep`
    with these names are replaced. An empty table gives an empty result.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    kept = [c for c in keep if c.lower() not in new]
    rows = docs.select(F.struct(*kept).alias("row"), tokens(text).alias("words"))
    rows = rows.select("row", F.size("words").cast("long").alias("n_words"), "words", matches(F.col("words"), index).alias("met"))
    # Few texts have any phrase: the others make no chains.
    phrases = F.exists("met", lambda m: m["template"] >= index.asked)
    none = F.filter("met", lambda m: F.lit(False))
    rows = rows.select("row", "n_words", "met", F.when(phrases, chained(F.col("words"), F.col("met"), index)).otherwise(none).alias("far"))
    # Phrases have done; a chain that stands where its template does is no second place.
    exact = F.filter("met", lambda m: m["template"] < index.asked)
    more = F.filter("far", lambda c: ~F.exists("met", lambda m: m["verified"] & (m["template"] == c["template"]) & (m["start"] == c["start"])))
    rows = rows.select("row", "n_words", F.concat(exact, F.array_distinct(more)).alias("found"))
    names = F.array(*[F.lit(t.label) for t in index.templates])
    base = F.array(*[F.lit(t.base) for t in index.templates])
    sure = F.filter("found", lambda m: m["verified"])
    own = F.filter(sure, lambda m: F.element_at(base, m["template"] + 1))
    rows = rows.select("row", "n_words", "found", sure.alias("sure"), own.alias("own"))

    def printed(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda m: F.element_at(names, m["template"] + 1)))), ",")

    strength = F.array_max(F.transform("found", lambda m: m["share"] * F.when(m["verified"], 1.0).otherwise(PARTIAL)))
    return rows.select(
        "row.*",
        "n_words",
        F.size("own").cast("long").alias("n_base"),
        F.array_min(F.transform("own", lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform("own", lambda m: m["start"])).alias("last_word"),
        printed("own").alias("base_labels"),
        printed("sure").alias("labels"),
        F.round(F.coalesce(strength, F.lit(0.0)), DIGITS).alias("score"),
        F.transform("sure", lambda m: F.struct(F.element_at(names, m["template"] + 1).alias("label"), m["start"].alias("start"))).alias("places"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents; nulls, repeats and the like as in `scan`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, build_index(document_frequencies(docs))).drop("places")


def _op1_sql(templates=TEMPLATES) -> str:
    """The same by joins of words and places."""
    every, chains = with_phrases(templates)
    rows, steps = [], []
    for number, t in enumerate(every):
        keys = sorted({at + i for at, words in t.key_places() for i in range(len(words))})
        rows.append(f"({number}, '{t.label}', {t.base}, '{' '.join(t.words())}', {keys})")
    for number, chain in chains:
        for k, (phrase, place) in enumerate(chain):
            low, high = way(chain, k - 1) if k else (0, 0)
            steps.append(f"({number}, {k}, {phrase}, {low}, {high}, {len(chain) - 1}, {len(every[number].words()) - place}, {chain[0][1]})")
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
tt(t, label, base, words, keys) AS (VALUES {", ".join(rows)}),
cc(t, k, phrase, low, high, last, n, place) AS (VALUES {", ".join(steps)}),
tw AS (SELECT t, place, word, list_contains(keys, place) AS key FROM (SELECT t, keys, unnest(range(len(string_split(words, ' ')))) AS place, unnest(string_split(words, ' ')) AS word FROM tt)),
p AS (SELECT r, i, word FROM (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM tw)),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN (SELECT word, count(DISTINCT r) AS n FROM p GROUP BY word) f ON f.word = v.word),
ranked AS (SELECT t, word, place, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS rank, count(*) OVER (PARTITION BY t) AS n FROM (SELECT t, word, min(place) AS place FROM tw WHERE key GROUP BY t, word) JOIN idf USING (word)),
m AS (SELECT r, t, i - place AS start FROM p JOIN ranked USING (word) WHERE rank = 1 AND i >= place INTERSECT SELECT r, t, i - place FROM p JOIN ranked USING (word) WHERE rank = least(2, n) AND i >= place),
judged AS (SELECT r, t, start, least(sum(CASE WHEN w[CAST(start + place + 1 AS INT)] = word THEN idf ELSE 0 END) / sum(idf), 1.0) AS share, bool_and(NOT key OR coalesce(w[CAST(start + place + 1 AS INT)] = word, false)) AS verified FROM m JOIN tw USING (t) JOIN idf USING (word) JOIN d USING (r) GROUP BY r, t, start),
ways AS (SELECT r, cc.t, 0 AS k, greatest(start - place, 0) AS head, start AS spot, last, n FROM judged JOIN cc ON phrase = judged.t AND k = 0 WHERE verified UNION SELECT ways.r, ways.t, ways.k + 1, ways.head, judged.start, ways.last, cc.n FROM ways JOIN cc ON cc.t = ways.t AND cc.k = ways.k + 1 JOIN judged ON judged.r = ways.r AND judged.t = cc.phrase AND judged.verified AND judged.start - ways.spot BETWEEN cc.low AND cc.high),
far AS (SELECT ways.r, ways.t, least(sum(CASE WHEN list_contains(d.w[CAST(head + 1 AS INT) : CAST(spot + ways.n AS INT)], v.word) THEN idf ELSE 0 END) / sum(idf), 1.0) AS share FROM ways JOIN d USING (r) JOIN (SELECT DISTINCT t, word FROM tw) v ON v.t = ways.t JOIN idf ON idf.word = v.word WHERE k = last GROUP BY ways.r, ways.t, head, spot),
every AS (SELECT r, t, start, share, verified FROM judged WHERE t < {len(templates)} UNION ALL SELECT r, t, NULL, share, true FROM far),
s AS (SELECT r, count(*) FILTER (verified AND base) AS n_base, min(start) FILTER (verified AND base) AS first_word, max(start) FILTER (verified AND base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(share * CASE WHEN verified THEN 1.0 ELSE {PARTIAL} END) AS score FROM every JOIN tt USING (t) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), {DIGITS}) AS score
FROM d LEFT JOIN s USING (r)
"""


OP1_SQL = _op1_sql()
