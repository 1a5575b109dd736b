import textwrap

from trackloom.llm import licenses as op
from trackloom.llm.queries import QUERIES

from .conftest import edge_rows, make

#: Standard headers as files hold them, wrapped over lines.
HEADERS = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def families(text):
    return {f for f, *_ in op.scan_text(text)}


def test_templates_are_found():
    for family, forms in op.TEMPLATES.items():
        for t in forms:
            assert families(t) == {family} == families(f"some words before. {t.upper()}, and after it"), t


def test_wrapped_headers_are_found():
    for family, text in HEADERS.items():
        for width in (30, 50, 70):
            wrapped = textwrap.fill(text, width)
            for put in (wrapped, "# " + wrapped.replace("\n", "\n# "), "Copyright 2020 The Authors\n\n" + wrapped + "\n\nimport os", "prose " * 100 + wrapped + " prose" * 100):
                assert families(put) == {family}, (family, width, put)


def test_no_notices():
    for t in [*op.NO_NOTICE, "the license", "licensed", "permission", "public domain", "", None, "plain words"]:
        assert op.scan_text(t) == [], t


def test_telling_words_lose_nothing():
    """A run without any of them can't hold enough of any template."""
    gate = set(op.telling())
    for t in (t for ts in op.TEMPLATES.values() for t in ts):
        form = set(t.split())
        assert len(form - gate) / len(form) < op.CONFIRM, t


def merged(found):
    n, last = 0, {}
    for family, _, part, start, end in sorted(found, key=lambda x: (x[0], x[2], x[3], x[4] - x[3])):
        before = last.get(family)
        n += before is None or before[0] < part or before[1] <= start
        last[family] = max(before or (part, end), (part, end))
    return n


def test_query_is_the_plain_rule(spark, sf_dir, documents, edge, empty):
    notice = [(100, "Intro line\nReleased under the MIT License.\n\nThis work is licensed under the GNU General Public License, version 3."), (101, "Licensed under CC BY-NC 4.0.")]
    notice += [(200 + i, "Intro.\n \n" + textwrap.fill(t, 40) + "\n\n" + "words " * 60 + textwrap.fill(t, 55)) for i, t in enumerate(HEADERS.values())]
    for docs in (documents, make(spark, [*edge_rows(), *notice, notice[0]])):
        rows = {}
        for r in op.scan(docs).collect():
            rows.setdefault(r.doc_id, []).append(r)
        for d in docs.collect():
            found = op.scan_text(d.text)
            assert any(
                r.n_notices == merged(found) and r.families == ",".join(sorted({f for f, *_ in found})) and (not found or abs(r.confidence - max(x[1] for x in found)) < 1e-9)
                for r in rows[d.doc_id]
            ), d.doc_id
    assert op.scan(empty).count() == 0
    assert QUERIES["op9_licenses"](spark, sf_dir).count() == documents.count()
