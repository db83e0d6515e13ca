"""License scans by MinHash bands over overlapping windows, with DataFrame functions only.

Windows of twice a template's length start every template length, so any
occurrence lies whole in one. A window and a template have one minimum for each
of `bands` hash functions, and a band holds one of them: a template that is
contained to the threshold shares a minimum with chance 1 - (1 - j)**bands,
where j >= threshold / (threshold + 2) is the least similarity of window and
template. For 40 bands and 0.8 that is over 0.999999. A window of a short
template has more shingles beside than j allows for: such a template gets as
many bands more as keep the chance of a miss below `MISS`.

A band of a window can only equal a template's if the window holds the very
shingle that gives the template its minimum. So windows are taken where a text
has such a shingle, their minima are computed, and bands that agree retrieve
templates: the same as bands of all windows, without those that can't agree.
Candidates are verified by the exact share of the template's shingles that the
window holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast
from .grams import gram_rows, plain_words

#: The largest chance to miss a window that holds a template to the threshold.
MISS = 1e-6

#: Hash functions of one template at most.
MOST_BANDS = 160

#: Public license texts, and wordings by which licenses are granted or named.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
        NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("template_id"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, containment: float = 0.8, bands: int = 40) -> DataFrame:
    """id_col, license, template_id, start_word, containment: the best window of each text for each template it holds.

    `known` has template_id, license and text. Words are lower-case runs of
    letters and digits; a template of fewer words than a shingle is one shingle
    of all its words. start_word is the first shared shingle's place in the
    best window; ties go to the earlier window. Null and empty texts hold
    nothing, very long ones are scanned whole. Templates without words and rows
    with a null id are not looked for; rows that repeat an id are looked at one by one
    and the best window of any counts once. Empty tables give an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    doc = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    temp = known.select("template_id", "license", plain_words(F.col("text")).alias("words")).filter("size(words) > 0").withColumn("len", F.size("words")).withColumn("n", F.least("len", F.lit(words)))
    temp = scratch.keep(temp, "templates")
    found = []
    for n in sorted(r["n"] for r in temp.select("n").distinct().collect()):
        of_n = temp.filter(F.col("n") == n)
        grams = scratch.keep(gram_rows(of_n, "words", n, "template_id", "len").select("template_id", "len", "gram").distinct(), "template-grams")
        size = grams.groupBy("template_id", "len").agg(F.count("*").alias("size"))
        need = F.ceil(F.col("size") * containment - 1e-9)
        least = need / (F.col("size") + F.col("len") * 2 - n + 1 - need)
        # bands that keep the chance of a miss small, of the least similar window that holds the template
        size = size.withColumn("bands", F.greatest(F.lit(bands), F.least(F.lit(MOST_BANDS), F.ceil(F.lit(math.log(MISS)) / F.log1p(-F.least(least, F.lit(0.9999)))))))
        size = scratch.keep(size, "template-sizes")
        most = size.agg(F.max("bands")).first()[0]

        def minima(rows: DataFrame, *key: str, most: int = most) -> DataFrame:
            """(key..., band, low, gram): the least hash of every function, and the shingle that has it."""
            low = rows.groupBy(*key).agg(*[F.min(F.struct(F.xxhash64("gram", F.lit(b)).alias("low"), "gram")).alias(f"m{b}") for b in range(most)])
            return low.select(*key, F.posexplode(F.array(*[f"m{b}" for b in range(most)])).alias("band", "m")).select(*key, "band", "m.low", "m.gram")

        theirs = minima(grams, "template_id", "len").join(checked_broadcast(size.select("template_id", "bands")), "template_id").filter("band < bands").drop("bands")
        theirs = scratch.keep(theirs, "template-bands")
        lookup = theirs.groupBy("gram").agg(F.collect_set("len").alias("lens"))
        places = gram_rows(doc.select("id", plain_words(F.col("text")).alias("words")), "words", n, "id").join(checked_broadcast(lookup), "gram")
        # the windows of each length that hold the place: those starting at the last two multiples of the length
        last = F.floor(F.col("pos") / F.col("len")) * F.col("len")
        near = places.select("id", "pos", F.explode("lens").alias("len")).select("id", "len", F.explode(F.array(last, last - F.col("len"))).alias("s")).filter("s >= 0")
        near = scratch.keep(near.distinct(), "windows")
        held = doc.join(checked_broadcast(near.select("id").distinct()), "id", "left_semi").select("id", plain_words(F.col("text")).alias("words")).dropDuplicates(["id", "words"])
        windows = held.join(near, "id").select("id", "len", "s", F.slice("words", (F.col("s") + 1).cast("int"), F.col("len") * 2).alias("words"))
        # rows that repeat an id with other words have windows of their own
        inside = gram_rows(windows.withColumn("own", F.xxhash64("words")), "words", n, "id", "len", "s", "own").groupBy("id", "len", "s", "own", "gram").agg(F.min("pos").alias("pos"))
        inside = scratch.keep(inside, "window-grams")
        mine = minima(inside, "id", "len", "s", "own").drop("gram")
        cand = mine.join(checked_broadcast(theirs.drop("gram")), ["len", "band", "low"]).select("id", "len", "s", "own", "template_id")
        cand = scratch.keep(cand.distinct(), "candidates")
        both = inside.join(cand, ["id", "len", "s", "own"]).join(checked_broadcast(grams), ["template_id", "len", "gram"])
        share = both.groupBy("id", "template_id", "s", "own").agg(F.count("*").alias("held"), F.min("pos").alias("first")).join(checked_broadcast(size.select("template_id", "size")), "template_id")
        share = share.withColumn("containment", F.col("held") / F.col("size")).filter(F.col("containment") >= containment - 1e-9)
        best = share.groupBy("id", "template_id").agg(F.max_by(F.struct((F.col("s") + F.col("first")).alias("at"), "containment"), F.struct("containment", -F.col("s"), -F.col("first"))).alias("b"))
        best = best.join(checked_broadcast(of_n.select("template_id", "license")), "template_id")
        found.append(best.select(F.col("id").alias(id_col), "license", "template_id", F.col("b.at").cast("long").alias("start_word"), F.col("b.containment").alias("containment")))
    if not found:
        return spark.createDataFrame([], f"{id_col} long, license string, template_id int, start_word long, containment double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
