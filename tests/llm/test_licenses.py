import textwrap

import numpy as np

from voltrace.llm import licenses

PLAIN = ["The quick brown fox", "my driver license was renewed", "copyright is a word", "version 2.0 of the file", "Than in ofblethti the and", "terms of the public"]


def test_templates_and_variants_are_found():
    model = licenses.train([])
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            for said in (t, t.upper(), f"Note: {t}"):
                got = model.classify(said)
                assert got is not None and got[0] == family and got[2] >= licenses.LEAST_SHARE, (said, got)
    for t in PLAIN:
        got = model.classify(t)
        assert got is None or got[0] == licenses.UNKNOWN or got[2] < licenses.LEAST_SHARE, (t, got)


def test_held_out_accuracy():
    rng = np.random.default_rng(99)
    model = licenses.train([])
    data = licenses._examples([], rng)
    right = [int(model.probabilities(x).argmax()) == y for x, y, _ in data]
    assert np.mean(right) > 0.95


def test_scan(spark):
    texts = ["a\nLicensed under CC BY-NC 4.0.\nb", "Released under the MIT License.\n\nLicensed under the Apache License, Version 2.0.", "x y z", "", None, PLAIN[1] * 500]
    rows = [(i, t, "q") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "All rights reserved.", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_paragraphs, r.n_license, r.families, r.family) for r in licenses.license_scan(df).collect())
    assert got == sorted([(0, 3, 1, "CC-BY-NC", "CC-BY-NC")] * 2 + [(1, 2, 2, "Apache-2.0,MIT", got[3][4]), (2, 1, 0, "", "unknown"), (3, 0, 0, "", "unknown"), (4, 0, 0, "", "unknown"),
                   (5, 1, 0, "", "unknown"), (-1, 1, 1, "Proprietary", "Proprietary")])
    assert licenses.license_scan(df.limit(0)).count() == 0


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def test_wrapped_notices_are_found(spark):
    rows, want = [], {}
    for family, text in WRAPPED.items():
        for width in (40, 60, 72, 80):
            for mark in ("", "# ", " * ", "// ", "dnl "):
                lines = [mark + x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width - len(mark)), ""]]
                for ahead in ([], ["int main(void);", "Than in ofblethti the and"]):
                    want[len(rows)] = family
                    rows.append((len(rows), "\n".join(ahead + lines)))
    for text in (*PLAIN, " ".join(PLAIN * 20)):
        rows.append((len(rows), "\n".join(textwrap.wrap(text, 30))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.family, r.families, r.n_license) for r in licenses.license_scan(df).collect()}
    for i, _ in rows:
        family, families, n = got[i]
        assert (family, families, n > 0) == ((want[i], want[i], True) if i in want else ("unknown", "", False)), (rows[i], got[i])
    two = WRAPPED["MIT"].replace("\n\n", " ") + " " + WRAPPED["MPL-2.0"]  # one block with two notices
    df = spark.createDataFrame([(1, "\n".join(textwrap.wrap(two, 72)))], "doc_id long, text string")
    assert licenses.license_scan(df).first().families == "MIT,MPL-2.0"


NOTICES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish and sell copies of the Software.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def test_each_wrapped_notice_gives_its_own_family(spark):
    import textwrap

    rows = [(f"{family} {width}", "\n".join(textwrap.wrap(text, width))) for family, text in NOTICES.items() for width in (1000, 100, 80, 72, 66, 60, 50)]
    rows.append(("unknown hotel", "All rights reserved by the hotel, says the guest"))
    rows.append(("Proprietary end", "Copyright 2024 Acme Ltd. All rights reserved."))
    got = {r.doc_id: r.families for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: k.split()[0].replace("unknown", "") for k in got}


def test_probabilities_against_a_dense_matrix():
    """The sparse sums of weights against a dense softmax over the whole vocabulary, with the families that names rule out taken away."""
    model = licenses.train([])
    for text in [*NOTICES.values(), "Released under the MIT License.", "the copyright of permission", "GNU General Public License", "Licensed under CC BY-SA 4.0."]:
        words = licenses.paragraph_words(text)
        x = np.zeros(len(licenses.VOCABULARY))
        for gram, k in licenses.VOCABULARY.items():
            x[k] = f" {gram} " in f" {' '.join(words)} "
        z = (x @ model.weights + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert np.allclose(p, model.probabilities(licenses.features(words)))
        for kind in licenses.KINDS:
            for family, own in kind.items():
                if set(own) != licenses.marks(words) & {m for x in kind.values() for m in x}:
                    p[licenses.FAMILIES.index(family)] = 0
        best = licenses.FAMILIES[int(p.argmax())]
        family = model.classify(text)[0]
        assert family == (best if best == "unknown" or p.max() >= licenses.LEAST_PROBABILITY * p.sum() else "unknown")


def test_background_is_drawn_by_hash(spark):
    rows = [(i, f"{chr(97 + i % 26)} software license number {i}") for i in range(3000)]
    drawn = licenses.background_sample(spark.createDataFrame(rows, "doc_id long, text string"), size=3000, most=260)
    first = {w[0] for w in drawn}
    assert len(drawn) == 260 and len(first) > 20
    long = licenses.background_sample(spark.createDataFrame([(1, "software " * 1000)], "doc_id long, text string"))
    assert sum(map(len, long)) == 1000


#: Notices of licences that no template is of, whole families that training never saw, and sentences that only resemble notices.
STRANGE = [
    "Licensed under the Zlib License.", "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the Artistic License, Version 2.0.", "Licensed under the European Union Public Licence, version 1.2.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Academic Free License version 3.0",
    "This software is provided 'as-is', without any express or implied warranty.", "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "Alice said that she has all rights reserved.", "did not release this under the MIT License.", "This work is not licensed under a Creative Commons Attribution 4.0 International License.",
    "He didn't want it licensed under the Apache License, Version 2.0.", "It was never licensed under the GNU General Public License, version 3.",
]
#: Notices that resemble another family's.
NAMED = {
    "Creative Commons Attribution-NoDerivatives 4.0": "CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "CC-BY-NC-SA", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND",
    "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "ECL-2.0", "Licensed under the OpenSSL License, Version 2.0.": "OpenSSL",
    "This is free and unencumbered software released into the public domain.": "Unlicense", "Licensed under the ISC license": "ISC", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": "BSL-1.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL", "SPDX-License-Identifier: BSD-3-Clause": "BSD", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA",
    "Copyright (c) 2024 Acme. All rights reserved.": "Proprietary",
}


def test_held_out_families_and_likenesses():
    model = licenses.train([])
    for text in STRANGE:
        got = model.classify(text)
        assert got is None or got[0] == licenses.UNKNOWN or got[2] < licenses.LEAST_SHARE, (text, got)
    for text, family in NAMED.items():
        got = model.classify(text)
        confirmed = got is not None and got[2] >= licenses.LEAST_SHARE
        assert (confirmed and got[0] == family) or (text.startswith("Creative") and not confirmed), (text, got)


def test_scan_against_lines_one_by_one(spark):
    """Documents of separate lines: what the scan finds is what the classifier says of each line, confirmed by pairs and telling words counted here."""
    texts = ["\n\n".join([*STRANGE, *NAMED]), "\n\n".join(reversed([*NAMED, *PLAIN])), "\n\n".join([*NOTICES.values()])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.train(licenses.background_sample(df))

    def confirmed(line):
        got = model.classify(line)
        if got is None or got[0] == licenses.UNKNOWN:
            return None
        words = licenses.paragraph_words(line)
        pairs = set(zip(words, words[1:], strict=False))
        for template in licenses.TEMPLATES[got[0]]:
            own = licenses.paragraph_words(template)
            wanted = set(zip(own, own[1:], strict=False))
            if len(own) < licenses.SHORT_WORDS:
                if words[-len(own):] == own and (len(words) < len(own) + 2 or "copyright" in words):
                    return got[0]
                continue
            others = {w for f, ts in licenses.TEMPLATES.items() if f != got[0] for t in ts for w in licenses.paragraph_words(t)}
            telling = {w for w in own if w not in others and w not in licenses.COMMON and not w.isdigit()}
            at = next((i for i, p in enumerate(zip(words, words[1:], strict=False)) if p in wanted), 0)
            if len(pairs & wanted) >= licenses.LEAST_SHARE * len(wanted) and 2 * len(telling & set(words)) >= len(telling) and not (set(words[max(0, at - 5):at + 5]) & licenses.NEGATIONS) - set(own):
                return got[0]
        return None

    got = {r.doc_id: (r.n_license, r.families) for r in licenses.license_scan(df).collect()}
    for k, text in enumerate(texts):
        found = [f for line in text.split("\n\n") if (f := confirmed(line)) is not None]
        assert got[k] == (len(found), ",".join(sorted(set(found))))
