"""Licence scan by canonical digest.

A text is brought to canonical form (ASCII letters lower-cased, equivalent spellings unified, copyright lines and
punctuation dropped, white space closed up) and digested with SHA-256. Entire texts are then hash-joined to the
digests of known licences. Everything happens in DataFrame functions.

Defined results: a null text has no digest and no licence; a text that is empty in canonical form has a digest but
no licence; texts of any length count whole; repeated rows get equal results; equal names among further columns are
replaced; of licences with equal digests the first name counts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.license_digests import DIGESTS

# Patterns in the order in which they apply, in a syntax that Java, Python and RE2 share.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(portions )?(copyright|\(c\)|©)[^\n]*"
SPELLINGS = [
    (r"licence", "license"),
    (r"\bsub-license", "sublicense"),
    (r"\bcopyright-holder", "copyright holder"),
    (r"\bnon-infringement", "noninfringement"),
    (r"\borganisation", "organization"),
    (r"\bmerchantibility", "merchantability"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bprogramme", "program"),
    (r"\bfavour", "favor"),
    (r"https?://", ""),
]
OTHER = r"[^a-z0-9\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Short licences whose texts are the same everywhere.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """BSD Zero Clause License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = {"0BSD": [ZERO_BSD], "Apache-2.0": [APACHE_NOTICE], "ISC": [ISC], "MIT": [MIT, MIT.split("\n\n", 1)[1]], "Zlib": [ZLIB]}


def canonical(text: Column) -> Column:
    """The canonical form as a column."""
    x = F.translate(text, UPPER, LOWER)
    x = F.regexp_replace(x, COPYRIGHT_LINE, "\n")
    for pattern, other in SPELLINGS:
        x = F.regexp_replace(x, pattern, other)
    x = F.regexp_replace(x, OTHER, " ")
    return F.trim(F.regexp_replace(x, r"[ \n]+", " "))


def canonical_text(text: str) -> str:
    """The canonical form of one text."""
    x = text.translate(str.maketrans(UPPER, LOWER))
    x = re.sub(COPYRIGHT_LINE, "\n", x)
    for pattern, other in SPELLINGS:
        x = re.sub(pattern, other, x, flags=re.ASCII)
    return re.sub(r"[ \n]+", " ", re.sub(OTHER, " ", x)).strip(" ")


def digests(known: dict[str, list[str]] = KNOWN) -> dict[str, str]:
    """Digest to licence; with the texts of KNOWN also those longer ones of which only digests are held."""
    out: dict[str, str] = {}
    for name in sorted({*known, *DIGESTS} if known is KNOWN else known):
        for text in known.get(name, []):
            if canonical_text(text):
                out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
        for digest in DIGESTS.get(name, []) if known is KNOWN else []:
            out.setdefault(digest, name)
    return out


def scan(df: DataFrame, text: str = "text", known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """Appends canonical_sha256 and license (null where no known licence has that digest)."""
    table = df.sparkSession.createDataFrame(sorted(digests(known).items()), "canonical_sha256 string, license string")
    out = df.drop("canonical_sha256", "license").withColumn("canonical_sha256", F.sha2(canonical(F.col(text)), 256))
    return out.join(F.broadcast(table), "canonical_sha256", "left")  # a fixed list
