import numpy as np
import pytest
from corpus import frame, rows

from tideweave.llm import licences as L


@pytest.fixture(scope="module")
def model():
    return L.train()


@pytest.mark.parametrize(
    "text, family",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("licensed under the GNU General Public License version 2 or later", "gpl-2.0"),
        ("RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("Licensed under the FooBar Public License", "unknown"),
        ("All rights reserved.", "unknown"),
        ("He got a driving license after the accident", "none"),
        ("Apache helicopters and the general public", "none"),
        ("The river and the stone walk", "none"),
    ],
)
def test_families(model, text, family):
    kind, _ = L.classify(model, L._words([text]), np.array([0]))
    assert L.CLASSES[kind[0]] == family


def test_held_out_samples(model):
    texts, y = L.samples(seed=99, each=20)
    words = L._words(texts)
    kind, _ = L.classify(model, words, np.arange(len(texts)))
    assert (kind == y).mean() > 0.9


def test_spans_point_at_lines(spark):
    text = "größe one two\nLicensed under CC BY-NC 4.0.\n\nreleased under the MIT License\n"
    data = [(1, text, "", "", 0, "", 0), (2, None, "", "", 0, "", 0), (2, "", "", "", 0, "", 0), (None, "x", "", "", 0, "", 0)]
    got = L.scan(frame(spark, data)).collect()
    one = next(r for r in got if r.doc_id == 1)
    raw = text.encode()
    assert [(x.family, raw[x.start : x.end].decode()) for x in one.licences] == [("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("mit", "released under the MIT License")]
    assert one.n_paragraphs == 3 and len(got) == 4 and all(not r.licences for r in got if r.doc_id != 1)
    assert L.scan(frame(spark, [])).collect() == []
    assert len(L.digest(L.scan(frame(spark))).collect()) == len(rows())


def test_wrapped_statements(spark):
    headers = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "isc": " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above",
        "gpl-3.0": "                    GNU GENERAL PUBLIC LICENSE\r\n                       Version 3, 29 June 2007",
        "apache-2.0": "Apache License\nVersion 2.0, January 2004",
        "agpl-3.0": "// Licensed under the\n// GNU Affero\n// General Public License,\n// version 3",
        "gpl-2.0": "the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License",
        "mit license": "Apache 2.0 License\nMIT\nLicense",
        "unknown": "all rights\nreserved",
    }
    data = [(i, f"größe der river\n\n{t}\n\nthe stone walk\n", "", "", 0, "", 0) for i, t in enumerate(headers.values())]
    data.append((99, "at the Apache License\n\nVersion 2.0, January 2004", "", "", 0, "", 0))
    data.append((100, "the driver lost his license\nafter the public accident\nand the river\n" * 3, "", "", 0, "", 0))
    got = {r.doc_id: r for r in L.scan(frame(spark, data)).collect()}
    for i, (family, t) in enumerate(headers.items()):
        raw = data[i][1].encode()
        want = [("apache-2.0", "Apache 2.0 License"), ("mit", "MIT\nLicense")] if family == "mit license" else [(family, t.strip())]
        assert [(x.family, raw[x.start : x.end].decode().strip()) for x in got[i].licences] == want, got[i].licences
    assert "apache-2.0" not in [x.family for x in got[99].licences] and not got[100].licences


def test_statements_in_long_lines(spark):
    stone = "thinonon was the enndre of ontiononea and ti haly eringti in that " * 40
    texts = {"mpl-2.0": "licensed under the Mozilla Public License, version 2.0", "unknown": "All rights reserved.", "none": "the stone"}
    data = [(i, f"{stone}{t} {stone}", "", "", 0, "", 0) for i, t in enumerate(texts.values())]
    got = {r.doc_id: r for r in L.scan(frame(spark, data)).collect()}
    assert [[x.family for x in got[i].licences] for i in range(3)] == [["mpl-2.0"], ["unknown"], []]
