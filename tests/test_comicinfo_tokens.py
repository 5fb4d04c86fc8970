"""Metadata documents whose tags are hard to read."""

from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafsieve.functions.comicinfo import update


def images(document):
    return [p.get("Image") for p in ElementTree.fromstring(document).iter("Page")]


@pytest.mark.parametrize("tag, other", [
    ("""<Page Bookmark="see Image='9'" Image="2"/>""", "see Image='9'"), ("""<Page Bookmark='a > Image="9" ' Image = '2' />""", 'a > Image="9" '),
    ("""<Page\n\tBookmark="x"\n\tImage="2"></Page>""", "x"), ("""<Page MyImage="5" Image="2" Bookmark=""/>""", ""), ("""<Page Image="&#50;" Bookmark="/&gt;"/>""", "/>"),
])
def test_numbers_inside_other_values(tag, other):
    document = f"<ComicInfo><PageCount>3</PageCount><Pages><Page Image='0'/>{tag}</Pages></ComicInfo>".encode()
    made = update(document, {0}, 2)
    page = ElementTree.fromstring(made).find("Pages/Page")
    assert images(made) == ["1"] and page.get("Bookmark") == other and b"<PageCount>2</PageCount>" in made


@pytest.mark.parametrize("document", [
    """<!DOCTYPE c [<!ENTITY p "<Page Image='0'/>">]><c><Pages>&p;<Page Image='1'/></Pages></c>""",
    """<!DOCTYPE c [<!ENTITY p "<Pages><Page Image='0'/></Pages>">]><c>&p;</c>""",
    """<!DOCTYPE c [<!ATTLIST Page Image CDATA "4">]><c><Pages><Page/></Pages></c>""", "<c><Pages>", "", "<c><Pages><Page Image=1/></Pages></c>",
])
def test_what_can_not_be_spliced_stays(document):
    assert update(document.encode(), {0}, 1) == document.encode()


_WORD = st.text(st.sampled_from("Image='\"<>&; 9/\n\té"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), _WORD, st.booleans(), st.sampled_from(["Page", "Page ", "Page\n"])), max_size=6), st.sets(st.integers(0, 6)))
def test_every_value_survives(rows, removed):
    tags = []
    for number, word, first, name in rows:
        parts = [f"Image={quoteattr(str(number))}", f"Bookmark={quoteattr(word)}"]
        tags.append(f"<{name} {' '.join(parts if first else parts[::-1])}/>")
    document = f"<ComicInfo><Pages>{''.join(tags)}</Pages></ComicInfo>".encode()
    found = [(p.get("Image"), p.get("Bookmark")) for p in ElementTree.fromstring(update(document, removed, 3)).iter("Page")]
    before = [p.get("Bookmark") for p in ElementTree.fromstring(document).iter("Page")]
    assert found == [(str(n - sum(r < n for r in removed)), b) for (n, *_), b in zip(rows, before, strict=True) if n not in removed]
