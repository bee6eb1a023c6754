import math
import re

import pytest

from matchloom.llm import licenses

WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "lgpl": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.",
    "agpl": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as\n// published by the Free Software Foundation, either version 3 of the\n// License, or (at your option) any later version.",
    "gpl": "This program is free software: you can redistribute it and/or modify\r\nit under the terms of the GNU General Public License as published by\r\nthe Free Software Foundation, either version 3 of the License, or\r\n(at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def plain_unit(words, model):
    gs = list(dict.fromkeys(licenses.grams(words)))
    found = [model.weights[g] for g in gs if g in model.weights]
    z = [(sum(w[k] for w in found) / math.sqrt(max(1, len(found))) + b) / model.temperature for k, b in enumerate(model.bias)]
    top = max(z)
    family = model.classes[z.index(top)] if 1 / sum(math.exp(v - top) for v in z) >= 0.5 else "unknown"
    return family, any(c == family and len(set(t) & set(gs)) >= 0.6 * len(t) - 1e-9 for c, t in licenses.template_grams())


def plain_scan(text, model):
    """(n_candidates, families, n_confirmed, n_unconfirmed, n_unknown) by plain loops."""
    held = set(licenses.keywords())
    windows = lambda ws: [ws] if len(ws) <= 512 else [ws[i : i + 512] for i in range(0, len(ws), 256)]
    judged = []
    for p in re.split(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+", text or ""):
        lines = re.split(r"\r\n|\r|\n", p)
        units = [w for t in (lines if len(lines) == 1 else [*lines, p]) for w in windows(licenses.tokens(t)) if held & set(w)]
        if units:
            judged.append({plain_unit(w, model) for w in units})
    sure = sorted(f for p in judged for f in {f for f, c in p if c})
    confirmed = sum(any(c for _, c in p) for p in judged)
    unknown = sum(all(f == "unknown" for f, _ in p) for p in judged)
    return len(judged), ",".join(f"{f}:{sure.count(f)}" for f in dict.fromkeys(sure)), confirmed, len(judged) - confirmed - unknown, unknown


def test_a_text_without_keywords_covers_too_little_of_every_template():
    held = set(licenses.keywords())
    for _, gs in licenses.template_grams():
        assert sum(not held & set(g.split()) for g in gs) < licenses.OVERLAP * len(gs)
    assert len(held & {"the", "of", "or", "and", "in", "a", "is", "to"}) == 0


def test_held_out_texts_are_not_trained_on(model):
    known = {t for ts in licenses.TEMPLATES.values() for t in ts} | set(licenses.OTHERS)
    held = [(t, c) for c, ts in licenses.HELD_OUT.items() for t in ts]
    assert not known & {t for t, _ in held}
    assert sum(plain_unit(licenses.tokens(t), model)[0] == c for t, c in held) >= 0.9 * len(held)


def rows():
    line = "Released under the MIT License."
    every = [(c, t) for c, ts in licenses.TEMPLATES.items() for t in ts] + [("", t) for t in licenses.OTHERS]
    out = [(f"{c}:1" if c else "", f"Some prose first.\r\n{t}\nAnd more.") for c, t in every]
    out += [(f"{c}:1", f"/*\n\n{t}\n\n*/ int main") for c, t in WRAPPED.items()]
    out += [(f"{c}:1", f"prose before\n{t}\nprose after") for c, t in WRAPPED.items()]
    out += [("apache:1", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."), ("apache:1", "Released under Apache 2.0."), ("gpl:1", "Released under GPLv3."), ("gpl:1", "GPLv2+"), ("lgpl:1", "GNU LGPL v2.1"), ("cc-by-nc:1", "| Licensed | under | CC | BY-NC | 4.0."), ("gpl:1", "This work is licensed under the GNU General Public License, version 3!!"), ("reserved:1", "All rights reserved")]
    out += [("", None), ("", ""), ("", " \n\n \n"), ("mit:1", "prose " * 30000 + "\n" + line), ("mit:1", "prose " * 3000 + line + " prose" * 3000), ("cc-by:1,mit:2", f"{line}\n\n{line}\n \nLicensed under CC BY 4.0."), ("mit:1", f"{line}\n{line}")]
    return out


def test_scan_matches_brute_force_and_finds_families(spark, model):
    data = rows()
    df = spark.createDataFrame([(i if i % 7 else None, t, w, i) for i, (w, t) in enumerate(data)], "doc_id long, text string, found string, doc_no int")
    got = licenses.scan(df.withColumn("doc_id", df.doc_no), model).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: tuple(r)[1:] for r in got}
    assert [(data[i], by_id[i]) for i in by_id if by_id[i] != plain_scan(data[i][1], model)] == []
    assert [(data[i], by_id[i][1]) for i in by_id if by_id[i][1] != data[i][0]] == []


def test_null_ids_repeats_and_an_empty_table(spark, model):
    line = "Released under the MIT License."
    got = licenses.scan(spark.createDataFrame([(None, line), (4, line), (4, line)], "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.families) for r in got) == [(0, "mit:1"), (4, "mit:1"), (4, "mit:1")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
