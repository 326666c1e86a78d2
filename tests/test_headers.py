import pytest

from gridloom.errors import InvalidDocument, MissingColumn
from gridloom.plans.headers import HeaderPaths, detect_header_offset


def rows(*lines):
    return [line.split(",") for line in lines]


def test_flat():
    h = HeaderPaths.flat(["Name", "name", ""], str.strip)
    assert h.names == ["Name", "name", ""] and h.is_flat and len(h) == 3
    with pytest.raises(InvalidDocument, match="Duplicate"):
        HeaderPaths.flat(["a", "a"])
    with pytest.raises(InvalidDocument):
        HeaderPaths.flat(["", ""])


def test_hierarchy():
    assert HeaderPaths.from_rows(rows("Person,,", "First,Last,Email")).paths == (("Person", "First"), ("Person", "Last"), ("Person", "Email"))
    assert HeaderPaths.from_rows(rows("Category,,,Notes", "Sub,Code,Desc,")).paths[-1] == ("Notes",)
    deep = HeaderPaths.from_rows(rows("Info,,", "Contact,,Address", "Email,Phone,City"))
    assert deep.names == ["Info.Contact.Email", "Info.Contact.Phone", "Info.Address.City"]
    with pytest.raises(InvalidDocument, match="Duplicate"):
        HeaderPaths.from_rows(rows("Category,Category", "Name,Name"))
    with pytest.raises(InvalidDocument, match="coexist"):
        HeaderPaths.from_rows([["Cat", ""], ["", "SubName"]])


def test_definition_and_header_rows():
    h = HeaderPaths.from_definition({"Identity": ["id", "name"], "Contact": {"Mail": ["home", "work"]}, "note": None})
    assert h.names == ["Identity.id", "Identity.name", "Contact.Mail.home", "Contact.Mail.work", "note"]
    assert h.header_rows() == [["Identity", "", "Contact", "", "note"], ["id", "name", "Mail", "", ""], ["", "", "home", "work", ""]]
    assert HeaderPaths.from_rows(h.header_rows()).paths == h.paths


def test_select_rename_require():
    h = HeaderPaths.from_rows(rows("Person,,X", "First,Last,"))
    chosen = h.select({"Person": ["Last"], "X": None})
    assert chosen.paths == (("Person", "Last"), ("X",)) and chosen.indices == (1, 2)
    assert h.select(["X", "Person"]).indices == (2, 0, 1)
    assert chosen.rename({"Person": {"Last": "Surname"}}).names == ["Person.Surname", "X"]
    with pytest.raises(MissingColumn) as e:
        h.require({"Person": ["Middle"], "Y": None})
    assert e.value.columns == ["Person.Middle", "Y"]
    with pytest.raises(InvalidDocument):
        HeaderPaths.flat(["A", "B"]).rename({"A": "B"})


def test_rows():
    h = HeaderPaths.from_rows(rows("P,,X", "a,b,"))
    keyed = h.key_row(["1", "2"])
    assert keyed == {"P": {"a": "1", "b": "2"}, "X": None} and h.flatten_row(keyed) == ["1", "2", None]


def test_detection():
    data = rows("Export", "By", "", "First Name,Email", "John,j@x")
    assert detect_header_offset(["First Name", "Email"], 1, data) == 2
    assert detect_header_offset(["Phone"], 1, data) is None
    assert detect_header_offset({"P": ["a"]}, 2, rows("t", "P,", "a,b")) == 1
