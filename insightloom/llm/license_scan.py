"""License scans (operator 5): sentence-rule recognition, all in Catalyst.

A text is normalised (lower case, words joined by one space, punctuation
dropped, sentence ends and line ends marked) and searched for known licence
sentences.  A sentence begins after a mark and stops before one; line ends
within it are wrapping and are skipped.  Where several fit, the longest is
taken.  The resulting identifier sequence is matched against ordered rules; the
first rule that fits names the licence.

Defined cases: null and empty texts give an empty sequence and a null licence.
Texts of any length are scanned whole.  Where several rules fit, the first one
names the licence.  Repeated sentences stay in the sequence.  Repeated rows are scanned one by one;
further columns are not read.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentence -> identifier: short notices, one to a line.
SENTENCES = {
    "released under the mit license": "MIT_GRANT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MIT_PERMISSION",
    "the software is provided as is without warranty of any kind": "NO_WARRANTY",
    "licensed under the apache license version 2 0": "APACHE2_GRANT",
    "you may not use this file except in compliance with the license": "APACHE2_COMPLY",
    "this work is licensed under the gnu general public license version 3": "GPL3_GRANT",
    "this work is licensed under the gnu general public license version 2": "GPL2_GRANT",
    "this program is free software": "FREE_SOFTWARE",
    "licensed under cc by nc 4 0": "CC_BY_NC4_GRANT",
    "licensed under cc by 4 0": "CC_BY4_GRANT",
    "redistributions of source code must retain the above copyright notice": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used": "BSD_NAME",
    "all rights reserved": "RESERVED",
}

_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_GPL = "you can redistribute it and or modify it under the terms of the gnu general public license"
_LATER = "of the license or at your option any later version"
_PROMOTE = "be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_BINARY = "# redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_APACHE_URL = "http www apache org licenses license 2 0"
_AT_GNU = "along with this program if not see http www gnu org licenses"

#: The same for the whole sentences of licence texts and headers.  A ``*`` stands
#: for 1 to 16 words (names of holders), a leading ``#`` for an item mark or none,
#: a ``;`` for a sentence's end or none.
NOTICES = {
    _MIT: "MIT_PERMISSION",
    _MIT + " " + _MIT_NOTICE: "MIT_PERMISSION",
    _MIT_NOTICE: "MIT_NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "NO_WARRANTY",
    "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT_LIABILITY",
    _BSD: "BSD_GRANT",
    _BSD + " 1": "BSD_GRANT",
    "use of this source code is governed by a bsd style license that can be found in the license file": "BSD_STYLE",
    "# " + _BSD_SOURCE: "BSD_SOURCE",
    _BSD + " " + _BSD_SOURCE: "BSD_SOURCE",
    _BSD_BINARY: "BSD_BINARY",
    _BSD_BINARY.replace(" this list of conditions", "").replace("notice and", "notice this list of conditions and"): "BSD_BINARY",
    _BSD_BINARY + " and": "BSD_BINARY",
    "# all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD_ADVERT",
    "# all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by *": "BSD_ADVERT",
    "# neither the name of * nor the names of its contributors may " + _PROMOTE: "BSD_NAME",
    "# neither the names of * nor the names of its contributors may " + _PROMOTE: "BSD_NAME",
    "# neither the name of * may " + _PROMOTE: "BSD_NAME",
    "nor the names of its contributors may " + _PROMOTE: "BSD_NAME",
    "# the name of * may not " + _PROMOTE: "BSD_NAME",
    "# the names of * may not " + _PROMOTE: "BSD_NAME",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD_WARRANTY",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSD_LIABILITY",
    "licensed under the apache license version 2 0 the license": "APACHE2_GRANT",
    "* licenses this file to you under the apache license version 2 0 the license": "APACHE2_GRANT",
    "apache license version 2 0 january 2004": "APACHE2_TITLE",
    "apache license version 2 0 january 2004 http www apache org licenses": "APACHE2_TITLE",
    "you may not use this file except in compliance with the license": "APACHE2_COMPLY",
    "you may obtain a copy of the license at": "APACHE2_COPY",
    "you may obtain a copy of the license at " + _APACHE_URL: "APACHE2_COPY",
    "you may obtain a copy of the license at " + _APACHE_URL.replace("http", "https"): "APACHE2_COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_AS_IS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE2_LIMITS",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL_HOPE",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_IMPLIED",
    "you should have received a copy of the gnu general public license along with this program": "GPL_COPY",
    "you should have received a copy of the gnu general public license " + _AT_GNU: "GPL_COPY",
    "you should have received a copy of the gnu general public license " + _AT_GNU.replace("http", "https"): "GPL_COPY",
}
_ISC = "permission to use copy modify and %s this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
NOTICES |= {
    _ISC % "or distribute": "ISC_PERMISSION",
    _ISC % "distribute": "ISC_PERMISSION",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_WARRANTY",
    "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_WARRANTY",
    "mozilla public license version 2 0": "MPL2_TITLE",
    "this source code form is subject to the terms of the mozilla public license v ; 2 0": "MPL2_GRANT",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2_COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2_COPY",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_GRANT",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UNLICENSE_ANYONE",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB_PERMISSION",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL1_PERMISSION",
    "boost software license version 1 0 august 17th 2003": "BSL1_TITLE",
    "distributed under the boost software license version 1 0": "BSL1_GRANT",
}
for _kind, _name in (("attribution", "CC_BY4"), ("attribution sharealike", "CC_BY_SA4"), ("attribution noncommercial", "CC_BY_NC4"), ("attribution noncommercial sharealike", "CC_BY_NC_SA4"), ("attribution noderivatives", "CC_BY_ND4")):
    NOTICES |= {f"{_lead} creative commons {_kind} 4 0 international license": f"{_name}_GRANT" for _lead in ("this work is licensed under a", "this work is licensed under the", "licensed under a", "licensed under the")}

#: Identifier of each general public licence -> its name, versions and titles' dates.
GNU = {
    "GPL": ("gnu general public license", {"2": "june 1991", "3": "29 june 2007"}),
    "LGPL": ("gnu lesser general public license", {"2 1": "february 1999", "3": "29 june 2007"}),
    "AGPL": ("gnu affero general public license", {"3": "19 november 2007"}),
}
for _id, (_name, _versions) in GNU.items():
    _terms = _GPL.replace("gnu general public license", _name)
    _by = _terms + " as published by the free software foundation"
    NOTICES |= {_by: f"{_id}_TERMS", "* is free software " + _by: f"{_id}_TERMS", f"see the {_name} for more details": f"{_id}_DETAILS"}
    for _v, _date in _versions.items():
        _tag = _id + _v.replace(" ", "")
        NOTICES[f"{_name} version {_v} {_date}"] = f"{_tag}_TITLE"
        for _end in (f"version {_v} {_LATER}", f"version {_v} or at your option any later version", f"version {_v} of the license", f"version {_v}"):
            NOTICES |= {f"{x}{_by} ; {y}{_end}": f"{_tag}_GRANT" for x in ("", "* is free software ") for y in ("", "either ")}
        NOTICES |= {f"{x}{_terms} version {_v} as published by the free software foundation": f"{_tag}_GRANT" for x in ("", "* is free software ")}

#: (licence, pattern over the identifiers joined and framed by one space); order decides.
#: Identifiers of the usual one-line marker, by the registry's names.
SPDX = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
_spdx = {name: "SPDX_" + name.upper().replace("-", "_").replace(".", "_") for name in SPDX}
NOTICES |= {"spdx license identifier " + name.lower().replace("-", " ").replace(".", " "): i for name, i in _spdx.items()}

RULES = (
    ("BSD-3-Clause", " BSD_SOURCE (.* )?BSD_BINARY (.* )?BSD_NAME "),
    ("BSD-2-Clause", " BSD_SOURCE (.* )?BSD_BINARY "),
    ("GPL-3.0", " GPL3_GRANT "),
    ("GPL-2.0", " GPL2_GRANT "),
    ("Apache-2.0", " APACHE2_GRANT "),
    ("MIT", " (MIT_GRANT|MIT_PERMISSION) "),
    ("CC-BY-NC-4.0", " CC_BY_NC4_GRANT "),
    ("CC-BY-4.0", " CC_BY4_GRANT "),
    ("Proprietary", " RESERVED "),
)

#: RULES with those of whole notices.
NOTICE_RULES = (
    *((name.removesuffix("-only").removesuffix("-or-later"), f" {i} ") for name, i in _spdx.items()),
    ("BSD-4-Clause", " BSD_SOURCE (.* )?BSD_BINARY (.* )?BSD_ADVERT (.* )?BSD_NAME "),
    *RULES[:2],
    ("AGPL-3.0", " AGPL3_(TITLE|GRANT) "),
    ("LGPL-3.0", " LGPL3_(TITLE|GRANT) "),
    ("LGPL-2.1", " LGPL21_(TITLE|GRANT) "),
    ("GPL-3.0", " GPL3_TITLE "),
    ("GPL-2.0", " GPL2_TITLE "),
    ("Apache-2.0", " APACHE2_TITLE "),
    ("MPL-2.0", " MPL2_(TITLE|GRANT) "),
    *RULES[2:-1],
    ("CC-BY-SA-4.0", " CC_BY_SA4_GRANT "),
    ("CC-BY-NC-SA-4.0", " CC_BY_NC_SA4_GRANT "),
    ("CC-BY-ND-4.0", " CC_BY_ND4_GRANT "),
    ("ISC", " ISC_PERMISSION "),
    ("BSL-1.0", " BSL1_(TITLE|GRANT|PERMISSION) "),
    ("Zlib", " ZLIB_PERMISSION "),
    ("Unlicense", " UNLICENSE_GRANT "),
    ("BSD", " (BSD_GRANT|BSD_STYLE) "),
    RULES[-1],
)

#: The cut and noise of the SQL counterpart, which knows the short notices only.
BREAK = r"[.!?;]+([ \t\r\n]+|\z)|\n"
NOISE = r"[^a-z0-9]+"
#: A whole sentence ends at such punctuation or at a line without a word.  A
#: run of punctuation is read once, from its start and as a whole.
SENTENCE_END = r"(?<![.!?;])[.!?;]++([ \t\r\n]++|\z)|\n[^a-z0-9\n]*+\n"
#: Marks in the lower-cased text: B a sentence's end, L a line's.
MARKED_NOISE = r"[^a-z0-9BL]+"


def _words(sentence: str, line: str, end: str) -> str:
    """The sentence as a regular expression; ``line`` may follow each word, ``end`` stands
    for a ``;`` and may follow the words of a ``*`` ("Inc."), unless that leads."""
    gap, (lead, *rest) = " " + line, sentence.split()
    some = "(?:[a-z0-9]+ %s){0,15}?[a-z0-9]+"
    words = [some % "" if lead == "*" else lead, *(some % end if w == "*" else w for w in rest)]
    return gap.join(words).replace("#" + gap, f"(?:[a-z0-9]{{1,3}}{gap})?").replace(";" + gap, end)


def anchors(sentences) -> list[str]:
    """A few strings, one of which each sentence holds within a word; picked greedily."""
    left, out = [set(s.split()) - {"*", "#", ";"} for s in sentences], []
    while left:
        words = sorted(w for w in set().union(*left) if len(w) > 4) or sorted(set().union(*left))
        held = {w: sum(any(w in v for v in s) for s in left) for w in words}
        out.append(max(words, key=lambda w: (held[w], len(w), w)))
        left = [s for s in left if not any(out[-1] in v for v in s)]
    return out


def sentence_ids(text: Column, sentences: dict = SENTENCES | NOTICES) -> Column:
    plain = {s.replace("; ", ""): i for s, i in sentences.items() if not set("*#") & set(s)}
    table = F.create_map(*(F.lit(x) for kv in plain.items() for x in kv))
    ordered = sorted(sentences, key=lambda s: (-len(s.split()), s))
    known = "[BL] (?:" + "|".join(_words(s, "(?:L )?", "(?:[BL] ){0,2}") for s in ordered) + ")(?= [BL])"
    low = F.lower(F.coalesce(text, F.lit("")))
    marked = F.regexp_replace(F.regexp_replace(low, SENTENCE_END, " B "), "\n", " L ")
    framed = F.concat(F.lit("B "), F.trim(F.regexp_replace(marked, MARKED_NOISE, " ")), F.lit(" B"))
    found = F.transform(F.regexp_extract_all(framed, F.lit(known), F.lit(0)), lambda s: F.regexp_replace(s, "[BL] ", ""))

    def identifier(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for t in reversed([t for t in ordered if set("*#") & set(t)]):
            out = F.when(F.rlike(s, F.lit(f"^{_words(t, '', '')}$")), F.lit(sentences[t])).otherwise(out)
        return F.coalesce(F.try_element_at(table, s), out)

    # Normalising never breaks or joins letters, so a known sentence holds its anchor as it is.
    held = F.rlike(low, F.lit("|".join(anchors(sentences))))
    return F.when(held, F.transform(found, identifier)).otherwise(F.array().cast("array<string>"))


def license_rule(ids: Column, rules=NOTICE_RULES) -> Column:
    framed = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(framed, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict = SENTENCES | NOTICES, rules=NOTICE_RULES) -> DataFrame:
    """One row per input row: id, identifier sequence, count, licence.  No shuffle."""
    found = docs.select(F.col(id_col), sentence_ids(F.col(text_col), sentences).alias("sentence_ids"))
    return found.select(id_col, F.array_join("sentence_ids", " ").alias("sentence_ids"), F.size("sentence_ids").cast("long").alias("n_sentences"), license_rule(F.col("sentence_ids"), rules).alias("license"))
