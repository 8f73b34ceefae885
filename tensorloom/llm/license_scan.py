"""License scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Templates are short notices, header blocks and whole license texts.  Document
frequencies of their words are counted over the whole corpus.  A passage can reach
the cosine threshold with a template only if it holds one of the template's
heaviest words (its other words together weigh too little; repeats count by their
logarithm, lest frequent words be among them), so one scan for those words finds every line where a notice may begin; the rest of the work is joins
over the passages that begin there.  Scored are, for each such line, the line and
the windows of some lengths from it on, whatever words the further lines hold, and
the file as a whole.  A passage's own weight counts all its words, so a passing
mention scores low.  Per file the best passage decides.  A file that is little
else than license text, or is named as one, licenses its directory; files without
a license take that of the nearest directory above them, found by joining
directories, not files, with ancestors.

All steps are DataFrame functions.  Tables with one row per template word are
broadcast; their size is that of the templates.

Defined results: null and empty texts have no license of their own but may
inherit one; the best cosine wins, ties go to the name that sorts first, then to
the longer passage; repeated paths are files of their own, judged by their own
texts; files at the top have the directory ``""``; a file without a path keeps its
own license and inherits nothing; texts are scanned whole, however long; an empty
table gives an empty result; columns of the input that clash with added ones are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import discard, materialize, without

# The public texts of short licenses, and the notices by which others are applied to a work.
MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = """
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
APACHE_HEAD = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_TAIL = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
# {} stands for nothing, "Lesser " or "Affero ".
GNU_HEAD = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GNU_TAIL = """
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details.
You should have received a copy of the GNU {}General Public License along with this program. If not, see https://www.gnu.org/licenses/.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def _gnu(kind: str) -> list[str]:
    head, tail = GNU_HEAD.replace("{}", kind), GNU_TAIL.replace("{}", kind)
    return [f"This work is licensed under the GNU {kind}General Public License, version 3", f"Licensed under the GNU {kind}General Public License, version 3", head, head + tail]


TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", APACHE_HEAD, f"{APACHE_HEAD} {APACHE_TAIL}"],
    "MIT": ["Released under the MIT License", MIT.strip().split("\n")[0], MIT, f"MIT License\n{MIT}"],
    "GPL-3.0": _gnu(""),
    "LGPL-3.0": _gnu("Lesser "),
    "AGPL-3.0": _gnu("Affero "),
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", BSD_HEAD + BSD_TWO + BSD_TAIL],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", BSD_HEAD, BSD_HEAD + BSD_TWO + BSD_THIRD + BSD_TAIL],
    "ISC": ["Licensed under the ISC License", ISC],
    "MPL-2.0": [MPL, f"{MPL} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law the author has waived all copyright and related rights to this work, CC0 1.0 Universal"],
    "proprietary": ["All rights reserved", "All rights reserved. No part of this work may be reproduced without permission"],
}

COSINE, FILE_SHARE = 0.75, 0.5
#: Lengths, in lines, of the passages that are scored from a line on.
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
LICENSE_NAMES = r"(?i)^(un)?licen[cs]e|^copying|^notice"
WORD = r"[\p{L}\p{N}]+(?:[.\-'][\p{L}\p{N}]+)*"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def _template_table(spark) -> DataFrame:
    rows = [(name, k, t) for name, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "license string, k int, t string").select("license", "k", F.explode(_words(F.col("t"))).alias("w")).groupBy("license", "k", "w").agg(F.count("*").alias("tf"))


def anchors(weights: dict[tuple, dict[str, float]], cosine: float) -> set[str]:
    """Words one of which a line needs to reach ``cosine`` with some template.

    By Cauchy-Schwarz a line of other words only scores at most the share of the
    template's norm that those words have.
    """
    out = set()
    for w in weights.values():
        norm = math.sqrt(sum(x * x for x in w.values()))
        rest = norm * norm
        for word, x in sorted(w.items(), key=lambda i: (-i[1], i[0])):
            if rest <= (cosine * norm) ** 2 * (1 - 1e-9):
                break
            out.add(word)
            rest -= x * x
    return out


def best_license(files: DataFrame, keys: list[str], text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """keys, license, score and share (of the file's words in its best passage) of files that reach ``cosine``.

    Files with equal ``keys`` count as one.
    """
    spark = files.sparkSession
    grams = _template_table(spark)
    tf: dict[tuple, dict[str, int]] = {}
    for r in grams.collect():
        tf.setdefault((r["license"], r["k"]), {})[r["w"]] = r["tf"]
    vocab = sorted({w for t in tf.values() for w in t})
    src = files.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    in_doc = F.array_intersect(_words(F.col("_t")), F.array(*[F.lit(w) for w in vocab]))
    df = {r["w"]: r["n"] for r in src.select(F.explode(in_doc).alias("w")).groupBy("w").count().withColumnRenamed("count", "n").collect()}
    total = src.count()
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocab}
    unseen = math.log(1 + total) + 1
    weights = {k: {w: (1 + math.log(n)) * idf[w] for w, n in t.items()} for k, t in tf.items()}

    need = "|".join("".join("\\" + c if not c.isalnum() else c for c in w) for w in sorted(anchors(weights, cosine)))
    has = lambda c: F.lower(c).rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{need})(?![\\p{{L}}\\p{{N}}])")
    found = src.where(has(F.col("_t"))).dropDuplicates(keys).withColumn("_l", F.split("_t", "\n"))
    found = found.withColumns({"_all": F.size(_words(F.col("_t"))), "_at": F.filter(F.transform("_l", lambda x, i: F.when(has(x), i)), lambda i: i.isNotNull())})
    # Passages: from each line that holds an anchor on, and (at -1) the whole file.
    starts = found.select(*keys, "_all", "_l", F.explode("_at").alias("_p")).select(*keys, "_all", "_p", F.slice("_l", F.col("_p") + 1, max(WINDOWS)).alias("_l"))
    width = F.explode(F.filter(F.array(*[F.lit(w) for w in WINDOWS]), lambda w: w <= F.size("_l")))
    passages = starts.select(*keys, "_all", "_p", "_l", width.alias("_w")).select(*keys, "_all", "_p", "_w", F.array_join(F.slice("_l", 1, F.col("_w")), "\n").alias("_t"))
    whole = found.select(*keys, "_all", F.lit(-1).alias("_p"), F.lit(0).alias("_w"), "_t")
    piece = [*keys, "_all", "_p", "_w"]
    tfs = passages.unionByName(whole).select(*piece, F.explode(_words(F.col("_t"))).alias("w")).groupBy(*piece, "w").agg(F.count("*").alias("tf"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "w string, idf double"))
    weighed = tfs.join(idfs, "w", "left").withColumn("x", (1 + F.ln("tf")) * F.coalesce("idf", F.lit(unseen)))
    # One row per passage with the words that templates know; the others count in its norm only.
    known = F.filter(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("w", "x"))), lambda r: r.isNotNull())
    each = materialize(weighed.groupBy(*piece).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").alias("n"), known.alias("known")), "passages")
    rows = [(lic, k, w, x / math.sqrt(sum(y * y for y in t.values()))) for (lic, k), t in weights.items() for w, x in t.items()]
    unit = F.broadcast(spark.createDataFrame(rows, "license string, k int, w string, u double"))
    dots = each.select(*piece, "norm", "n", F.explode("known").alias("r")).select(*piece, "norm", "n", "r.w", "r.x").join(unit, "w")
    scored = dots.groupBy(*piece, "norm", "n", "license", "k").agg(F.sum(F.col("x") * F.col("u")).alias("dot")).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= cosine)
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "license", (-F.col("n")).alias("n"), "_all")).alias("b"))
    out = materialize(best.select(*keys, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (-F.col("b.n") / F.col("b._all")).alias("share")), "own")
    discard(each)
    return out


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """The columns of ``files`` but the text, plus license, license_score, license_from (header, file, inherited or none) and license_dir."""
    files = without(files, "license", "license_score", "license_from", "license_dir", "_dir", "_name", "_path", "_hash", "_file", "_up", "_inherited", "score", "share")
    keyed = files.withColumns({"_path": F.col(path_col), "_hash": F.xxhash64(text_col)})
    own = best_license(keyed, ["_path", "_hash"], text_col, cosine)
    named = keyed.drop(text_col).withColumn("_dir", F.regexp_replace("_path", "/?[^/]*$", "")).withColumn("_name", F.element_at(F.split("_path", "/"), -1))
    same = named["_path"].eqNullSafe(own["_path"]) & (named["_hash"] == own["_hash"])
    licenses = F.col("license").isNotNull() & ((F.col("share") >= file_share) | F.coalesce(F.col("_name").rlike(LICENSE_NAMES), F.lit(False)))
    judged = materialize(named.join(own, same, "left").drop(own["_path"]).drop(own["_hash"]).withColumn("_file", licenses), "judged")

    licensed = judged.where("_file AND _dir IS NOT NULL").groupBy("_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select(F.col("_dir").alias("_up"), F.col("b.license").alias("_inherited"))
    dirs = judged.where("_dir IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ups = dirs.select("_dir", F.explode(F.array_distinct(above)).alias("_up"))
    nearest = ups.join(licensed, "_up").groupBy("_dir").agg(F.max(F.struct(F.length("_up").alias("n"), "_up", "_inherited")).alias("b")).select("_dir", F.col("b._up").alias("_up"), F.col("b._inherited").alias("_inherited"))
    out = judged.join(nearest, "_dir", "left")
    kind = F.when(F.col("_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("_inherited").isNotNull(), "inherited").otherwise("none")
    discard(own)
    return out.select(
        *[F.col(f"`{c}`") for c in files.columns if c != text_col],
        F.coalesce("license", "_inherited").alias("license"),
        F.col("score").alias("license_score"),
        kind.alias("license_from"),
        F.when(F.col("license").isNull(), F.col("_up")).alias("license_dir"),
    )
