import os

import pytest

from wellspark.llm import licenses

FOLDER = "/usr/share/common-licenses"
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["row_id"]: (r["license"], list(r["notices"])) for r in licenses.scan(docs).collect()}


def test_entire_texts_and_notices(spark):
    texts = [
        BSD.format(""),
        "BSD 3-Clause License\n\n" + BSD.format(THIRD),
        "words\n# SPDX-License-Identifier: BSD-3-Clause\nwords",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Distributed under the Boost Software License, Version 1.0.",
        BSD.format("") + "and more",
    ]
    got = found(spark, texts)
    assert got[0][0] == "BSD-2-Clause" and got[1][0] == "BSD-3-Clause" and got[5] == (None, [])
    assert got[2] == (None, ["BSD-3-Clause"]) and got[3] == ("LGPL-2.1-or-later", ["LGPL-2.1-or-later"])
    assert got[4][1] == ["BSL-1.0"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts on this machine")
def test_entire_texts_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = []
    for name in names:
        with open(f"{FOLDER}/{name}", encoding="utf-8") as f:
            texts.append(f.read())
    got = found(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == list(names.values())
