from latticeforge.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
CASES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Text here. This work is licensed under the GNU General Public License, version 3. More.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Copyright (c) 2020 X\nAll rights reserved.": "All-Rights-Reserved",
    MIT: "MIT",
    MIT + "\nReleased under the MIT License.\nSPDX-License-Identifier: MPL-2.0": "MIT",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "My driving license expired.": "",
    "Nothing here.": "",
}


def test_rules(spark):
    rows = [(t, 1, "x") for t in CASES] + [(None, 1, "x"), ("", 1, "x"), ("license " * 30000, 1, "x")]
    df = spark.createDataFrame(rows, "text string, licenses int, n_unknown string")
    out = licenses.recognise(df, prefix="found_")
    assert out.columns == [*df.columns, "found_licenses", "found_sentence_ids", "found_n_unknown"]
    got = {r["text"]: r for r in out.collect()}
    for text, want in CASES.items():
        assert got[text]["found_licenses"].split(",")[0] == want, text
    assert got[MIT]["found_sentence_ids"] == "mit-grant,mit-notice,as-is,no-liability"
    assert got["My driving license expired."]["found_n_unknown"] == 1
    assert got[None]["found_licenses"] == got[""]["found_sentence_ids"] == ""
    assert licenses.recognise(df.limit(0), prefix="f").collect() == []

WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY.""",
    "BSD-3-Clause": """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 3. Neither the name of the University nor the names of its contributors
 *    may be used to endorse or promote products.
 *
 * THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND
 * ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
 * REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.
 */""",
    "GPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License v. 2.0
which is available at https://www.eclipse.org/legal/epl-2.0.""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS.
// See the License for the specific language governing permissions and
// limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file.""",
}


def test_licences_as_they_are_wrapped(spark):
    rows = list(WRAPPED.items()) + [("long", "word " * 300 + "this file is licensed under the Apache License, Version 2.0 " + "word " * 700), ("one line", "Released under the MIT License\nand nothing else")]
    df = spark.createDataFrame(rows, "name string, text string")
    got = {r["name"]: r for r in licenses.recognise(df).collect()}
    for name in WRAPPED:
        assert got[name]["licenses"].replace("All-Rights-Reserved", "").strip(",") == name, got[name]
    assert got["long"]["licenses"] == "Apache-2.0" and got["one line"]["licenses"] == "MIT"
    assert got["MIT"]["sentence_ids"] == "?,copyright,mit-grant,mit-notice,as-is,no-liability"
    assert got["Zlib"]["sentence_ids"] == "zlib-as-is,no-liability,zlib-grant,zlib-origin,zlib-altered,zlib-notice"
    assert got["BSD-3-Clause"]["sentence_ids"] == "bsd-grant,bsd-source,bsd-binary,bsd-endorse,as-is,no-liability"
    assert got["Apache-2.0"]["sentence_ids"] == "apache-2.0,apache-use,apache-copy,apache-basis,apache-see"
