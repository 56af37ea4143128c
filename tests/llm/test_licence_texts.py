"""Licences recognised in the unabridged, wrapped texts in which they are given."""

import pytest

from tallygrid.llm import licences

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """3. Neither the name of Some Organisation nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = GPL3.replace(":", ";").replace("Foundation,", "Foundation;").replace("3", "2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file."""


def marked(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "-- "])
def test_wrapped_texts(spark, mark):
    texts = [MIT, APACHE, BSD, BSD3, GPL3, GPL2, MPL, "Home\nReleased under the\nMIT License\nMenu"]
    rows = spark.createDataFrame([(i, marked(text, mark)) for i, text in enumerate(texts)], "doc_id bigint, text string")
    found = [r.licences for r in licences.digest(rows).orderBy("doc_id").collect()]
    assert found == ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "MPL-2.0", "MIT"]


def test_spdx_expressions(spark):
    texts = ["// SPDX-License-Identifier: MIT\nint x;", "/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0+) */",
             "# spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: BUSL-1.1.",
             "SPDX-License-Identifier: MIT\n\n" + APACHE]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = [(r.licences, r["class"]) for r in licences.digest(rows).orderBy("doc_id").collect()]
    assert found == [
        ("MIT", "permissive"), ("Apache-2.0,GPL-2.0+", "copyleft"), ("GPL-2.0-only", "copyleft"), ("BUSL-1.1", "restricted"),
        ("Apache-2.0,MIT", "permissive")]
