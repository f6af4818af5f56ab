"""Licence scan by canonical digests. Native.

A text is brought to a canonical form (lower case, no lines that name holders
of a copyright, no lines that are titles, no punctuation, one spelling of words
that are spelled in two ways, single spaces) and its SHA-256 is looked up among
the digests of known licences by a hash join. The known digests are made by the
very same expressions, of short licences (``TEXTS``) in each run, of long ones
once (``DIGESTS``). The lines of a text are looked up the same way among known
one-line notices.

A holder's line begins with a copyright sign, or with the word and a sign, a
year or a placeholder behind it; so lines that merely begin with the word, as
any line of a licence can where it is wrapped, stay. What goes on in the line
below a holder's line stays as well, and such a text is not found.

* Null and empty texts, and those of punctuation alone, have the digest of the
  empty form and no licence.
* Rows are kept one to one: repeated rows repeat, an empty table gives none.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence texts without their titles' and holders' lines, as published by their authors.
TEXTS = {
    "MIT": 'MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'ISC License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'BSD Zero Clause License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Copyright (c) <year> <owner>\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Copyright (c) <year> <owner>\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "zlib License\n\nCopyright (c) <year> <owner>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>',
}
#: One-line notices, each with the licence that it names.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This work is licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "This work is licensed under CC BY 4.0.": "CC-BY-4.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: ISC": "ISC",
}
#: Digests of the canonical forms of long licences as their authors publish them (FSF's of 2007 or with
#: the Franklin Street address), with what follows their terms, and without ("how to apply").
DIGESTS = {
    "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6": "Apache-2.0",
    "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff": "Apache-2.0",
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b": "GFDL-1.2",
    "1dbd72b6f124a1058e786b52a9d4afe44543b834a3aa44faf6c18b747c9de8e2": "GFDL-1.2",
    "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d": "GFDL-1.3",
    "911b9e1b02471fa9b19ec482d019380acd7e0fef00ffbd4395e8813b06533fe7": "GFDL-1.3",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "18285bb1ad96820bff9c9d0ad8afd287be81e1fb278bd99ca194d3a69d622294": "MPL-1.1",
    "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b": "MPL-1.1",
    "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de": "MPL-2.0",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}
#: Patterns and what replaces them, in this order, on lower-case text. Both Java's and RE2's dialect.
STEPS = [
    (r"(?:^|\n)[ \t/*#;%-]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]|<|\[|\{|by[ \t])|\(c\)[ \t]*(?:copyright|[0-9<\[{])|©)[^\n]*", "\n"),
    (r"(?:^|\n)[ \t/*#;%-]*all rights reserved[ \t.*/#-]*(\n|$)", "\n$1"),
    (r"(?:^|\n)[ \t/*#;%-]*(?:(?:the )?(?:mit|expat|x11|isc|zlib|0bsd|bsd|bsd zero[- ]clause|bsd [0-9][- ]clause|[0-9][- ]clause bsd|new bsd|simplified bsd)(?: [\"'][a-z0-9 ]+[\"'])? licen[cs]e(?: \([a-z0-9 /.-]+\))?|boost software license - version 1\.0 - august 17th, 2003)[ \t:.*/#-]*(\n|$)", "\n$1"),
    (r"(licen)ce(s|d|e|es|or)?\b", "$1se$2"),
    (r"\b(author|recogn|organ|initial|util|summar|favor|custom|normal)is(e|es|ed|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(acknowledg)e(ments?)\b|\b(fulfil)(ments?)\b", "$1$3$2$4"),
    (r"\b(non|sub)(?:[ -]|-\n[ \t/*#;%-]*)(commercial|infringement|license)", "$1$2"),
    (r"\bhttps\b", "http"),
    (r"[^\p{L}\p{N}\n]+", " "),
]
_LINES = r" *\n *"
CUES = ("licens", "released")


def _cleaned(text: Column) -> Column:
    """The canonical form with line breaks left in."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return out


def _digest(cleaned: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(cleaned, F.lit("[ \n]+"), F.lit(" "))), 256)


def digests_of(spark, texts: dict[str, str]) -> DataFrame:
    """digest, license of texts, by the scan's own expressions."""
    rows = spark.createDataFrame([(x, k) for k, x in texts.items()], "text string, license string")
    return rows.select(_digest(_cleaned(F.col("text"))).alias("digest"), "license")


def known(spark, texts: dict[str, str], digests: dict[str, str] | None = None) -> DataFrame:
    """digest, license: digests of known texts, and digests that are known by themselves."""
    more = spark.createDataFrame(list((digests or {}).items()), "digest string, license string")
    return digests_of(spark, texts).unionByName(more).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), notices (licences that single lines name, sorted, joined by commas).

    The tables of known digests are the caller's constants, not data, so they
    are broadcast; the documents are read once and never shuffled.
    """
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    lines, cleaned = {}, []
    for row in spark.createDataFrame([(x,) for x in notices], "text string").select("text", _cleaned(F.col("text")).alias("cleaned"), _digest(_cleaned(F.col("text"))).alias("digest")).collect():
        lines[row.digest] = notices[row.text]
        cleaned.append(row.cleaned)
    # A map of constants: each line costs one look-up, and nothing is exploded. If every notice
    # has one of two words, lines without them need no digest.
    names = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair]) if lines else F.create_map().cast("map<string,string>")
    each = F.split(F.col("cleaned"), _LINES)
    if all(any(w in x for w in CUES) for x in cleaned):
        each = F.filter(each, lambda x: x.contains(CUES[0]) | x.contains(CUES[1]))
    found = F.transform(each, lambda x: F.element_at(names, F.sha2(F.trim(x), 256)))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _cleaned(F.col("text")).alias("cleaned"))
        .select("doc_id", _digest(F.col("cleaned")).alias("digest"), F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",").alias("notices"))
        .join(F.broadcast(known(spark, TEXTS, DIGESTS) if texts is None else known(spark, texts)), "digest", "left")
        .select("doc_id", "digest", "license", "notices")
    )


def scan_sql() -> str:
    """The same rows in SQL, with the known texts as literals."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def cleaned(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        for pattern, to in STEPS:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
        return x

    def digest(x: str) -> str:
        return f"sha256(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"

    values = lambda d: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in d)
    return f"""
with texts as (select digest, min(license) as license from (select {digest(cleaned('text'))} as digest, license from (values {values([(x, k) for k, x in TEXTS.items()])}) v(text, license) union all values {values(DIGESTS.items())}) group by 1),
notices as (select distinct {digest(cleaned('text'))} as digest, license from (values {values(NOTICES.items())}) v(text, license)),
docs as (select row_number() over () as r, doc_id, {cleaned('text')} as cleaned from documents),
lines as (select r, unnest(regexp_split_to_array(cleaned, ' *\\n *')) as line from docs),
named as (select r, string_agg(distinct license, ',' order by license) as names from lines join notices on sha256(trim(line)) = digest group by r)
select doc_id, {digest('cleaned')} as digest, texts.license as license, coalesce(names, '') as notices
from docs left join texts on {digest('cleaned')} = texts.digest left join named using (r)"""
