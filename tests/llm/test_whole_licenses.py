"""Licences inside prose and wrapped texts, which no whole line or paragraph is."""

import textwrap

from codeweft.llm import license_scan

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."


def test_inside(spark):
    texts = {
        textwrap.fill(MIT, 60): {"MIT"},
        "# " + "\n# ".join(textwrap.wrap(GPL, 60)): {"GPL-3.0"},
        textwrap.fill(BSD, 70): {"BSD-2-Clause"},
        "This project is licensed under the MIT License.": {"MIT"},
        "Our library. Released under the MIT License. See LICENSE for details.": {"MIT"},
        "An introduction of some words\nReleased under the MIT License.\nand more that follows": {"MIT"},
        "A license is a permit to use, copy or modify a work under terms that the holder of the rights has set.": set(),
        "": set(),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.license_scan(docs).collect()
    for d, (text, want) in enumerate(texts.items()):
        mine = [r for r in got if r.doc_id == d]
        assert {r.license for r in mine} == want and len(mine) == len(want), text
