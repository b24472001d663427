"""Licence texts as they stand in files: wrapped, in comments, with sentences that go on."""

import re

from paddock.llm import common, licenses

CASES = {
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction',
    "GPL-3.0": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
    "GPL-2.0": "under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.",
    "LGPL-2.1": "under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License",
    "BSD-3-Clause": "All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\nnotice.\n2. Redistributions in binary form must reproduce the above\ncopyright notice.\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that:\n1. Redistributions of source code must retain the above\n2. Redistributions in binary form must reproduce the above",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-3.0": "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 3.0 Unported License.",
    "Apache-2.0,MIT": "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    "Proprietary": "Copyright 2020.\nAll rights\nreserved.",
    "": "The summit sits under a clear sky; a driving licence was needed to submit the form.",
}


def test_wrapped_texts(spark):
    df = spark.createDataFrame([*CASES.items(), ("", None)], "doc_id string, text string")
    wrong = [tuple(r) for r in licenses.license_scan(df).select("doc_id", "text_licenses").collect() if r.doc_id != r.text_licenses]
    assert wrong == []


def test_given_statements_are_recognised(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    stated = [r.doc_id for r in docs.collect() if re.search(r"Licensed under CC BY-NC 4\.0", r.text or "")]
    assert stated and all("CC-BY-NC-4.0" in got[d].text_licenses for d in stated)
    known = lambda r: set(r.licenses.split(",")) - {"Proprietary", ""}
    assert [r for r in got.values() if not known(r) <= set(r.text_licenses.split(","))] == []
