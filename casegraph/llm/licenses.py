"""Licence scans: Dice coefficient over word bigrams against templates, pruned by size.

A passage (a line, or a block of lines between blank ones) resembles a template if twice the shared distinct bigrams
over both counts is at least the threshold, which bounds the passage's count by the template's. Passages without a
tell-tale word are left out first, which loses nothing: the words are chosen so that what a template has besides them
is too little for the threshold. DataFrame functions only.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_hash

THRESHOLD = 0.8

# Public notices and licence texts.
TEMPLATES = {
    "MIT-notice": ("MIT", "Released under the MIT License."),
    "MIT-licensed": ("MIT", "Licensed under the MIT License."),
    "MIT-text": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache-2.0-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "Apache-2.0-header": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "GPL-2.0-notice": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "GPL-header": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-3.0-notice": ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "AGPL-3.0-notice": ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    "CC-BY-4.0-notice": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0-notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "CC-BY-text": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-notice": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "BSD-2-text": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "ISC-text": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense-notice": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "MIT-warranty": ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MIT-full": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD-2-full": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-full": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-2-conditions": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "BSD-3-conditions": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "BSD-3-endorsement": ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "BSD-warranty": ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "ISC-warranty": ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "ISC-full": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "Apache-2.0-disclaimer": ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "Apache-2.0-boilerplate": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "Apache-2.0-copyright-grant": ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    "Apache-2.0-patent-grant": ("Apache-2.0", "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted. If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed."),
    "GPL-2.0-header": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-warranty": ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "Unlicense-text": ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}

# Words of the templates that other texts use often; they tell little.
EVERYDAY = frozenset(
    "under without source including public general terms subject version otherwise provided purpose action author authors contract copies extent "
    "shall commercial either conditions other following including person particular direct business procurement services substitute special "
    "possibility necessarily application possible waived works their where those which through product products support specific prior written".split()
)


def _bigrams(text: str) -> list[str]:
    w = re.findall(r"[^\W_]+", text.lower().replace("licence", "license"))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


@cache
def telling(threshold: float = THRESHOLD) -> tuple[str, ...]:
    """Words one of which every passage has that reaches the threshold with some template.

    Greedily the word that leaves least of the templates that still could be reached without the words so far; everyday
    words only where a template's other words do not suffice.
    """
    chosen: set[str] = set()
    own = {name: [set(b.split()) for b in _bigrams(text)] for name, (_, text) in TEMPLATES.items()}
    rest = lambda name, words: sum(words.isdisjoint(b) for b in own[name])
    open_ = lambda name, words: 2 * (r := rest(name, words)) / (r + len(own[name])) >= threshold
    while left := [n for n in own if open_(n, chosen)]:
        words = {w for n in left for b in own[n] if chosen.isdisjoint(b) for w in b if len(w) > 4 or w == "cc"}
        words = sorted(words - EVERYDAY or words)
        chosen.add(min(words, key=lambda w: (sum(open_(n, chosen | {w}) for n in left), sum(rest(n, chosen | {w}) for n in left))))
    return tuple(sorted(chosen))


def _normal(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("licence"), F.lit("license"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def license_matches(documents: DataFrame, threshold: float = THRESHOLD, sentences: bool = False) -> DataFrame:
    """(doc_id, kind, passage, template, license, n_bigrams, dice): each passage's best template at the threshold.

    kind is 'line' or 'block' (of two lines or more), passage its number in the text from 0. With sentences, which end at a
    stop and white space or at the line's end, 'sentence' is a third kind: notices amid other text of their line. Words are runs of letters
    and digits in lower case, licence spelt license; a passage of one word matches nothing, nor do null and empty texts.
    Ties go to the template's name. Rows that repeat id and text give one result; ids may repeat or be null; other
    columns are ignored; an empty table gives no rows.
    """
    if threshold < THRESHOLD:
        raise ValueError("the tell-tale words are chosen for the usual threshold")
    docs = documents.where("text IS NOT NULL").select("doc_id", text_hash().alias("h"), _normal(F.col("text")).alias("t"))
    tell = F.array(*map(F.lit, telling()))
    # words, the test and the explode in one expression: a filter on a column would compute the words again
    part = lambda kind, parts: F.filter(F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("passage"), _words(x).alias("w"))), lambda p: F.arrays_overlap(p["w"], tell))
    blocks = F.transform(F.split("t", r"\n[ \t\r]*\n", -1), lambda x: F.when(F.contains(x, F.lit("\n")), x).otherwise(""))
    parts = [part("line", F.split("t", "\n", -1)), part("block", blocks)]
    if sentences:
        parts.append(part("sentence", F.split("t", r"(?<=[.!?])[ \t]+|[ \t]*\n", -1)))
    passages = docs.select("doc_id", "h", F.explode(F.concat(*parts)).alias("p")).select("doc_id", "h", "p.*").where("size(w) > 1")
    made = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))))
    sized = passages.select("doc_id", "h", "kind", "passage", made.alias("b")).withColumn("n_bigrams", F.size("b"))
    most = max(len(_bigrams(t)) for _, t in TEMPLATES.values())
    sized = sized.where(F.col("n_bigrams") <= most * (2 - threshold) / threshold)
    spark = documents.sparkSession
    rows = [(name, lic, len(_bigrams(text)), b) for name, (lic, text) in TEMPLATES.items() for b in _bigrams(text)]
    templates = F.broadcast(spark.createDataFrame(rows, "template string, license string, n int, bigram string"))  # fixed
    probes = sized.select("doc_id", "h", "kind", "passage", "n_bigrams", F.explode("b").alias("bigram"))
    bounds = (F.col("n_bigrams") >= F.col("n") * threshold / (2 - threshold) - 1e-9) & (F.col("n_bigrams") <= F.col("n") * (2 - threshold) / threshold + 1e-9)
    shared = probes.join(templates, "bigram").where(bounds).groupBy("doc_id", "h", "kind", "passage", "template", "license", "n", "n_bigrams").agg(F.countDistinct("bigram").alias("s"))
    dice = F.round(2 * F.col("s") / (F.col("n") + F.col("n_bigrams")), 6)
    scored = shared.withColumn("dice", dice).where(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "h", "kind", "passage", "n_bigrams").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "license")).alias("m"))
    return best.select("doc_id", "kind", "passage", "m.template", "m.license", "n_bigrams", (-F.col("m.d")).alias("dice"))


def op6_license_scan(documents: DataFrame) -> DataFrame:
    return license_matches(documents).select("doc_id", "kind", F.col("passage").cast("long").alias("passage"), "template", "license", F.col("n_bigrams").cast("long").alias("n_bigrams"), "dice")


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, {quote(lic)}, {quote(text)})" for n, (lic, text) in TEMPLATES.items())


SQL = rf"""
WITH tpl(template, license, text) AS (VALUES {_values()}),
tw AS (SELECT template, license, list_filter(string_split_regex(replace(lower(text), 'licence', 'license'), '[^\p{{L}}\p{{N}}]+'), lambda w: w != '') AS w FROM tpl),
tb AS (SELECT DISTINCT template, license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw),
tn AS (SELECT template, license, count(*) AS n FROM tb GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, text, replace(lower(text), 'licence', 'license') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, string_split(t, chr(10)) AS x FROM d), k AS (SELECT doc_id, text, string_split_regex(t, '\n[ \t\r]*\n') AS x FROM d),
p AS (SELECT doc_id, text, 'line' AS kind, unnest(range(0, len(x))) AS passage, unnest(x) AS x FROM l
  UNION ALL SELECT * FROM (SELECT doc_id, text, 'block' AS kind, unnest(range(0, len(x))) AS passage, unnest(x) AS x FROM k) WHERE contains(x, chr(10))),
pw AS (SELECT doc_id, text, kind, passage, list_filter(string_split_regex(x, '[^\p{{L}}\p{{N}}]+'), lambda w: w != '') AS w FROM p),
pb AS (SELECT DISTINCT doc_id, text, kind, passage, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM pw),
pn AS (SELECT doc_id, text, kind, passage, count(*) AS n_bigrams FROM pb GROUP BY ALL),
s AS (SELECT pb.doc_id, pb.text, pb.kind, pb.passage, tb.template, tb.license, count(*) AS s FROM pb JOIN tb USING (b) GROUP BY ALL),
z AS (SELECT s.doc_id, s.text, s.kind, s.passage, s.template, s.license, n_bigrams, round(2 * s.s / (n + n_bigrams), 6) AS dice
  FROM s JOIN pn USING (doc_id, text, kind, passage) JOIN tn USING (template)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, kind, passage ORDER BY dice DESC, template) AS rn FROM z WHERE dice >= 0.8)
SELECT doc_id, kind, passage, template, license, n_bigrams, dice FROM r WHERE rn = 1
"""
