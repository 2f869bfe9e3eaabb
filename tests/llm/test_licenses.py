import re

import numpy as np

from blockwave.llm import licenses

from . import cases

GPL = "This program is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{1} either version {2} of the License, or\n(at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
MIT = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"


def test_wrapped_notices(spark):
    notices = [(GPL.format(":", ",", 3), "GPL-3.0"), (GPL.format(";", ";", 2), "GPL-2.0"), (LGPL, "LGPL"), (BSD, "BSD"), (MIT, "MIT"), ("Released under the\nMIT License.", "MIT")]
    texts, want = [], []
    for k, (notice, family) in enumerate(notices):
        for j, mark in enumerate(("", "// ", " * ", "# ", "dnl ")):
            d = 10 * k + j
            texts.append((d, f"{mark}plain words here\n{mark.rstrip() if j < 4 else ''}\n" + "\n".join(mark + x for x in notice.split("\n")) + "\n\nmore words"))
            want.append((d, 2, family))
    got = licenses.scan(cases.frame(spark, texts)).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == want
    assert all(r["template_match"] >= 0.8 and 0 <= r["probability"] <= 1 for r in got)


def test_whole_lines_stay_as_they_are(spark):
    text = "Released under the MIT License.\nplain words\nLicensed under CC BY 4.0.\n\n" + LGPL + "\nReleased under the BSD 3-Clause License."
    got = licenses.scan(cases.frame(spark, [(1, text)])).collect()
    found = sorted((r["paragraph"], r["family"]) for r in got)
    assert found == [(0, "MIT"), (2, "CC-BY-4.0"), (4, "LGPL"), (8, "BSD")]


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS.'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
WHOLE_MIT = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + MIT + ' (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
WHOLE_BSD = "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + BSD + "\n\n1. Redistributions of source code must retain the above copyright notice.\n\n2. Redistributions in binary form must reproduce the above copyright notice."


def test_headers_and_whole_files(spark):
    texts = [(1, APACHE), (2, MPL), (3, WHOLE_MIT), (4, WHOLE_BSD), (5, GPL.format(":", ",", 3) + "\n\nThis program is distributed in the hope that it will be useful."), (6, LGPL)]
    got = licenses.scan(cases.frame(spark, texts)).collect()
    known = {d: {r["family"] for r in got if r["doc_id"] == d} - {"unknown"} for d, _ in texts}
    assert known == {1: {"Apache-2.0"}, 2: {"MPL-2.0"}, 3: {"MIT"}, 4: {"BSD"}, 5: {"GPL-3.0"}, 6: {"LGPL"}}


def plain_words(text):
    return [w for w in re.split("[^a-z0-9]+", re.sub(r"(?im)^[ \t]*(?:dnl|rem)[ \t]+", "", text).lower()) if w]


def plain_pairs(w):
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_shares(pairs):
    out = []
    for notices in licenses.TEMPLATES.values():
        parts = [set(plain_pairs(plain_words(t))) for t in notices]
        out.append(max(len(p & set(pairs)) / len(p) for p in parts))
    return out


def plain_scan(text, m):
    """(paragraph, family, probability) of a text, line by line and run by run, without Spark."""
    anchors = {max((w for w in g.split(" ") if licenses.telling(w)), key=lambda w: (len(w), w)) for g in m.vocab}
    weights = dict(zip(m.vocab, m.weights))
    families, out = list(licenses.TEMPLATES), []
    lines = (text or "").split("\n")
    full = [any(c.isalnum() for c in x) for x in lines]
    k = 0
    while k < len(lines):
        if not full[k]:
            k += 1
            continue
        end = k
        while end < len(lines) and full[end]:
            end += 1
        run, units, wide = lines[k:end], [], None
        if not anchors & set(plain_words("\n".join(run))):
            k = end
            continue
        if len(run) > 1 and max(plain_shares(plain_pairs(plain_words("\n".join(run))))) >= licenses.WRAPPED:
            rest = "\n".join(x for x in run if max(plain_shares(plain_pairs(plain_words(x)))) < licenses.WRAPPED)
            shares = plain_shares(plain_pairs(plain_words(rest)))
            if max(shares) >= licenses.WRAPPED:
                wide = (shares.index(max(shares)) if shares.count(max(shares)) == 1 else -1, max(shares))
                units.append((k, True, rest))
        units += [(k + i, False, x) for i, x in enumerate(run)]
        for place, own, line in units:
            w = plain_words(line)
            pairs = plain_pairs(w)
            hits = {*w, *pairs} & set(m.vocab)
            if not anchors & set(w) or not hits:
                continue
            z = m.bias + sum(weights[h] for h in hits)
            best = int(z.argmax())
            sure = own and wide[0] >= 0
            best = wide[0] if sure else best
            p = float(np.exp(z[best] - z.max()) / np.exp(z - z.max()).sum())
            if m.classes[best] == licenses.NONE and not own:
                continue
            match = wide[1] if own else plain_shares(pairs)[best] if best < len(families) else 0.0
            line_ok = best < len(families) and p >= m.thresholds[families[best]] and match >= licenses.MATCH
            if wide is not None and not own and not (line_ok and match >= licenses.WRAPPED):
                continue
            known = sure if own else line_ok
            out.append((place, m.classes[best] if known else licenses.UNKNOWN, round(p, 9)))
        k = end
    return out


def test_query_against_a_plain_scorer(spark, sf_dir):
    from blockwave.llm.queries import op8_licenses

    m = licenses.model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((r["doc_id"], *x) for r in docs for x in plain_scan(r["text"], m))
    got = sorted((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 9)) for r in op8_licenses(spark, sf_dir).collect())
    assert got == want and want
    odd = [(1, APACHE), (2, WHOLE_MIT), (3, WHOLE_BSD), (4, "Licensed under the Example Corp Commercial License, version 7.\n" + LGPL), (5, GPL.format(";", ";", 2)), (6, MPL)]
    want = sorted((d, *x) for d, t in odd for x in plain_scan(t, m))
    got = sorted((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 9)) for r in licenses.scan(cases.frame(spark, odd)).collect())
    assert got == want and any(f == "unknown" for _, _, f, _ in got)


AGPL = GPL.format(":", ",", 3).replace("GNU General Public", "GNU Affero General Public")
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
ZLIB = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"
EPL = "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"
OWNED = "This software is proprietary and confidential.\nUnauthorized copying of this file, via any medium, is strictly prohibited."
WHOLE = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
    "LGPL": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------",
}


def test_each_licence_has_its_own_family_or_is_unknown(spark):
    notices = [(AGPL, "AGPL-3.0"), (ISC, "ISC"), (ZLIB, "Zlib"), (EPL, "EPL-2.0"), (OWNED, "unknown"), *[(t, f) for f, t in WHOLE.items()]]
    notices += [(f"SPDX-License-Identifier: {x}", f) for x, f in (("AGPL-3.0-or-later", "AGPL-3.0"), ("ISC", "ISC"), ("Zlib", "Zlib"), ("EUPL-1.2", "unknown"), ("LicenseRef-Proprietary", "unknown"))]
    got = licenses.scan(cases.frame(spark, list(enumerate(t for t, _ in notices)))).collect()
    known = {k: {r["family"] for r in got if r["doc_id"] == k} for k, _ in enumerate(notices)}
    for k, (text, family) in enumerate(notices):
        assert known[k] - {"unknown"} == {family} - {"unknown"} and known[k], (text, known[k])
