"""Licence scan by canonical digest lookup.

A text is brought into one form (case, punctuation, white space, copyright lines,
equivalent spellings). Where two words in a row are the first two of a known licence, the run
of as many words as that licence has is taken as one text and its digest is looked up among
the digests of known licences. So a licence is found as a whole document, as a line, wrapped
over several lines, behind comment marks, and inside a longer text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import ascii_lower, stored, texts

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = f"""{AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so"""
MIT_END = f"""{AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version {0} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part,
and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.
IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
#: Licence names and the texts, or the statements, that are them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", f"{MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {MIT_END}"),
    ("MIT-0", f"{MIT_GRANT}. {MIT_END}"),
    ("ISC", f"{GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}"),
    ("0BSD", f"{GRANT}. {ISC_END}"),
    ("BSD-2-Clause", f"{BSD_2} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_2} {BSD_3} {BSD_END}"),
    ("Apache-2.0", APACHE_NOTICE),
    ("GPL-2.0-or-later", GPL_NOTICE.format(2)),
    ("GPL-3.0-or-later", GPL_NOTICE.format(3)),
    ("MPL-2.0", MPL_NOTICE),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
)
#: Long public licences, with and without what follows their terms, by name, first two words, number of words and SHA-256 of their canonical form.
DIGESTS = (
    ("Apache-2.0", "apache license", 1578, "e09a2331f9142fe9a067013e3186d19dc36c9b48d1a91d19e8b59565e6731f44"),
    ("Apache-2.0", "apache license", 1408, "ce1beee48bda859516a49645d3dd4871f950bfd2f98016ef2347bc4a5c9e83ed"),
    ("CC0-1.0", "cc legal", 1079, "a21f9aaef005de8866667cf4d782fc07a0a14a5ef87710207a50cb8486a2be68"),
    ("GPL-2.0", "gnu general", 2965, "1c26969e4ab772a45bb63289818e2ee190f1ecfe5046850795f83696a7430df4"),
    ("GPL-2.0", "gnu general", 2497, "2a56efbbac802dd31dc98a7fcf575ccd284b3bd00b73746dcf9cf860b47707bf"),
    ("GPL-3.0", "gnu general", 5664, "7528e480f6357a5c55128fa7e794ef9af58429ea8203685f463edc99be3a0f70"),
    ("GPL-3.0", "gnu general", 5223, "220f2a61c6778a8ff5646466c9f128d8ba6015a2283709248d57f4b354d202bd"),
    ("LGPL-2.1", "gnu lesser", 4374, "60e84cc8be2398cb396005349fecdf83e758ed79234e4c8ee3eb8932db3a56ab"),
    ("LGPL-2.1", "gnu lesser", 4040, "a5ee292a9e0824fc9ce16e862575cba0ac24101d6ef953cea907ca6d90e45963"),
    ("LGPL-3.0", "gnu lesser", 1225, "98190aebbe68069474ea985795bccc3b7d648c79be11aac438902eea7299b5b4"),
    ("MPL-2.0", "mozilla public", 2405, "78f5f43323f3d13d0d8ac32186b0cbe0d70d3940566843a857277793dec17669"),
    ("GFDL-1.3", "gnu free", 3723, "8721ef7bd9be23d5cd7e5f37802e309e2944795702133daf00046a139f56ff80"),
)
#: Spellings that count as the same, as pattern and replacement, applied in this order to folded text.
EQUIVALENT = (
    ("\\ball rights reserved\\b", ""),
    ("\\blicence(s|d|es)?\\b", "license$1"),
    ("\\bsub licen[cs]e(s|d)?\\b", "sublicense$1"),
    ("\\bnon (commercial|infringement)\\b", "non$1"),
    ("\\bcopyright (?:owner|holder)s?\\b", "copyright holder"),
    ("\\backnowledgement\\b", "acknowledgment"),
    ("\\band or\\b", "and"),
    ("\\bcreative commons\\b", "cc"),
    ("\\bhttps\\b", "http"),
    ("\\bversion ([0-9])", "v$1"),
    ("\\bv ([0-9])", "v$1"),
    (" +", " "),
)
#: A line that states a copyright, up to a sentence in it that starts a licence statement.
COPYRIGHT_LINE = r"(?im)^[ \t/*#;.-]*(?:copyright\b(?! (?:holder|owner|notice))|\(c\)|©)[^\n]*?(?:$|\.(?=\s+(?:licen[cs]ed|released|permission|redistribution|this|all rights)\b))"
#: Every known licence holds a word with this in it, or one of its own long words; texts without any aren't looked at further.
STEM = "licen"


def canonical(text: Column) -> Column:
    """The form that is compared: words of letters and digits, one blank apart, copyright lines left out."""
    form = ascii_lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    form = F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))
    for pattern, to in EQUIVALENT:
        form = F.regexp_replace(form, pattern, to)
    return F.trim(form)


def known_licenses(spark, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(digest, license, first, n, mark): each known text once; mark is a piece of a word that any copy of it holds. Of names with one digest the first counts."""
    form = F.col("form")
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(known)], "place int, license string, body string").withColumn("form", canonical(F.col("body")))
    word = F.split(form, " ")
    longest = F.array_max(F.transform(word, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = table.select("place", "license", F.concat_ws(" ", F.get(word, F.lit(0)), F.get(word, F.lit(1))).alias("first"), F.size(word).alias("n"), F.sha2(form, 256).alias("digest"), F.when(form.contains(STEM), F.lit(STEM)).otherwise(longest).alias("mark"))
    if digests:
        long = [(len(known) + i, *d, STEM) for i, d in enumerate(digests)]
        rows = rows.unionByName(spark.createDataFrame(long, "place int, license string, first string, n int, digest string, mark string"))
    return rows.groupBy("digest").agg(*[F.min_by(c, "place").alias(c) for c in ("license", "first", "n", "mark")])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(doc_id, whole_license, n_licenses, licenses), one row per distinct doc_id.

    whole_license is the licence that the whole text is, or null; n_licenses counts the places
    at which a known licence stands; licenses lists their names, sorted, joined by commas (''
    if none). Rows that repeat a doc_id are pooled under it, those that repeat its text too count once. Null, empty and blank texts have
    no licence. An empty table gives an empty result. A known text of one word isn't looked for.
    """
    rows = known_licenses(docs.sparkSession, known, digests).collect()  # as many as the lists of known licences
    starts: dict[str, list[int]] = {}
    for r in rows:
        starts[r.first] = sorted({*starts.get(r.first, ()), r.n})
    text = texts(docs, id_col, text_col)
    ids = text.select("doc_id").distinct()
    marks = "|".join(sorted({r.mark for r in rows})) or "(?!)"
    lengths = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if rows else F.create_map().cast("map<string,array<int>>")
    word = text.where(ascii_lower(F.col("text")).rlike(marks)).select("doc_id", F.xxhash64("text").alias("row"), F.split(canonical(F.col("text")), " ").alias("w"))
    pair = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))
    at = word.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.map_contains_key(lengths, pair(i))))
    # explode_outer, since the filter that explode implies would be pushed down and make the form again for each word.
    one = at.select("doc_id", "row", "w", F.explode_outer("at").alias("at")).select("doc_id", "row", "w", "at", F.explode_outer(F.try_element_at(lengths, pair(F.col("at")))).alias("n")).where("at + n <= size(w)")
    run = one.select("doc_id", "row", "at", ((F.col("at") == 0) & (F.col("n") == F.size("w"))).alias("whole"), F.sha2(F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " "), 256).alias("digest"))
    table = docs.sparkSession.createDataFrame([(r.digest, r.license) for r in rows], "digest string, license string")
    found = run.join(F.broadcast(table), "digest")
    per_doc = found.groupBy(F.col("doc_id").alias("of")).agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.countDistinct("row", "at").alias("places"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"),
    )
    per_doc = stored(per_doc)
    return ids.join(per_doc, ids.doc_id.eqNullSafe(per_doc.of), "left").select("doc_id", "whole_license", F.coalesce("places", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("names", F.lit("")).alias("licenses"))
