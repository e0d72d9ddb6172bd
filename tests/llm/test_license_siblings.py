"""Licences of one family are told apart, and an unknown sibling gets no name."""

import pytest

from terrapipe.llm import licenses

GNU = "This work is licensed under the GNU {}General Public License, version {}"


@pytest.fixture(scope="module")
def scan():
    return licenses.scanner(licenses.TEMPLATES, 0.8)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GNU.format("", "2"), ["GPL-2.0"]),
        (GNU.format("", "3"), ["GPL-3.0"]),
        (GNU.format("", "1"), []),
        (GNU.format("Lesser ", "3"), ["LGPL-3.0"]),
        (GNU.format("Lesser ", "2.1"), ["LGPL-2.1"]),
        (GNU.format("Affero ", "3"), ["AGPL-3.0"]),
        ("Licensed under CC BY-SA 3.0", ["CC-BY-SA-3.0"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC0 1.0.", ["CC0-1.0"]),
        ("Released under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ],
)
def test_siblings(scan, text, want):
    assert [x[0] for x in scan(f"Some words. {text} And more.")] == want


def test_every_template_is_found_under_its_own_name(scan):
    found = [(name, [x[0] for x in scan(text)]) for name, text in licenses.TEMPLATES]
    assert [f for f in found if f[1] != [f[0]]] == []
