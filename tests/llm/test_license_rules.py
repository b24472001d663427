"""Sentence rules on licence texts as they stand in files: wrapped, commented, denied, several in one text; and against SQL."""

import duckdb
import pytest

from paddock.llm import common, licenses

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\n   notice.\n2. Redistributions in binary form must reproduce the above\n   copyright notice.\n"
NAME = "3. Neither the name of ACME nor the names of its contributors\n   may be used to endorse.\n"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software.\n\nThe above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
CASES = [
    ("BSD-3-Clause", BSD + NAME), ("BSD-2-Clause", BSD), ("BSD-3-Clause,BSD-2-Clause", BSD + NAME + BSD), ("MIT", MIT), ("MIT,BSD-3-Clause", MIT + "\n" + BSD + NAME),
    ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n'),
    ("GPL-3.0", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."),
    ("LGPL-2.1", "you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License"),
    ("", "This is not licensed under the MIT license. We compared it. It is not\nLicensed under the Apache License, Version 2.0."), ("", "Some text about licences and permission."), ("", ""), ("", None),
    ("CC-BY-NC-4.0", "title\nLicensed under CC BY-NC 4.0.\nmore"), ("Proprietary", "Copyright 2020.\nAll rights\nreserved."), ("MIT", "All rights reserved. Released under the MIT License."), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"),
]


def test_licence_texts(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, (_, t) in enumerate(CASES)], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.sequence) for r in licenses.license_rules(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: w for k, (w, _) in enumerate(CASES)}, got


@pytest.mark.parametrize("source", ["cases", "documents"])
def test_against_sql(spark, source):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents") if source == "documents" else spark.createDataFrame([(k, t) for k, (_, t) in enumerate(CASES + CASES)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("rows", docs.select("doc_id", "text").toArrow())
    want = con.execute(licenses.rules_sql("rows")).fetchall()
    assert sorted(tuple(r) for r in licenses.license_rules(docs).collect()) == sorted(want) and any(r[3] for r in want)
