"""License scans by canonical digest lookup. DataFrame functions only.

A text is brought to canonical form: A-Z lower-cased, copyright lines dropped, all
but letters a-z and digits read as one blank, equivalent spellings unified. A line is a
copyright line where it begins with "copyright" and no word that a licence's own
sentence goes on with ("copyright notice", "copyright holders"), with (c) and a year, with
the sign or with "all rights reserved". The
SHA-256 of the canonical form of the whole text is hash-joined to the digests of
known licences; so is that of every line, which finds one-line notices. The built-in
digests are a table of fixed size and are broadcast; a table read by ``read_known``
(long texts such as the GPL are not built in) is joined as Spark sees fit. Documents
are only shuffled by id and without their texts.

Null texts have a null digest and no licence; texts that are empty in canonical form
have the digest of the empty text and no licence. A repeated id shares the notices
of its rows; a null id has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, applied in this order to canonical words.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https", "http"),
]

# Known licences (SPDX identifier, text). Public licence texts and usual one-line notices.
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_0BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_MIT0 = _MIT.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
    "source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
    'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
    "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
    "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
    "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    'language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE "
    "LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
    "copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
    "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    'perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
    "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
    "permissions and limitations under the License."
)
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    ("BSD-2-Clause", _GRANT + "1. " + _BSD1 + "2. " + _BSD2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License " + _GRANT + "1. " + _BSD1 + "2. " + _BSD2 + _BSD_END),
    ("BSD-3-Clause", _GRANT + "1. " + _BSD1 + "2. " + _BSD2 + "3. " + _BSD3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License " + _GRANT + "1. " + _BSD1 + "2. " + _BSD2 + "3. " + _BSD3 + _BSD_END),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License " + _0BSD),
    ("MIT-0", _MIT0),
    ("MIT-0", "MIT No Attribution " + _MIT0),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License " + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 " + _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of a licence's own text that begins with "copyright": the blank behind that word becomes ~.
OWN_LINE = r"(^|\n)([^a-z0-9\n(©]*copyright)[ \t]+(notices?|holders?|owners?|laws?|licen[sc]e[a-z]*|and|or|in|is|are|to|the|of|for|interests?|statements?|treat[a-z]*|protection|ownership|infringement)\b"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n(©]*(copyright[^a-z0-9~\n]|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The text's canonical form."""
    lower = F.regexp_replace(F.translate(text, UPPER, LOWER), OWN_LINE, "$1$2~$3")
    words = F.regexp_replace(F.regexp_replace(lower, COPYRIGHT_LINE, " "), "[^a-z0-9]+", " ")
    for spelling, unified in SPELLINGS:
        words = F.replace(words, F.lit(spelling), F.lit(unified))
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license): one row for each known text."""
    known = spark.createDataFrame(KNOWN, "license string, text string")
    return known.groupBy(digest(F.col("text")).alias("known")).agg(F.min("license").alias("license"))


def read_known(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, license) of the texts in a folder, each file named by its licence, as in GPL-3.0-only.txt."""
    texts = spark.read.text(folder, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.[a-z]+$", "").alias("license"))
    return texts.groupBy(digest(F.col("value")).alias("known")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """id, digest of the whole text, license that the whole text is (or null), notices: sorted licences of its lines, comma-joined."""
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = rows.select("id", digest(F.col("text")).alias("digest")).join(known, F.col("digest") == F.col("known"), "left").select("id", "digest", "license")
    lines = rows.where("id is not null").select("id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), digest))).alias("line"))
    notices = (
        lines.join(known, F.col("line") == F.col("known")).groupBy("id")
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("notices"))
    )
    return whole.join(notices, "id", "left").select(F.col("id").alias(id_col), "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
