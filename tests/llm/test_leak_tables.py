"""Control characters in ASCII texts."""

from glyphtrail.llm import leaks


def test_control_characters_in_ascii_do_not_count():
    assert leaks.normalise("A pas\x01sage\x7f here\n") == "a passage here\n"
    assert leaks.symbols("pas\x01sage one", False) == ["passage", "one"]
