import pytest

from relpoint.llm.licenses import Scanner


def labels(text, scanner=Scanner()):
    return {s.label for s in scanner.scan(text.lower().encode().split())[1]}


@pytest.mark.parametrize(
    "text",
    [
        "the film was released under the title of a song",
        "it is licensed under the bsd license",
        "licensed under the mozilla public license",
        "copyright c all contributors of the project",
        "this source code form is subject to the terms of the other license",
    ],
)
def test_frame_without_the_name_is_no_licence(text):
    assert labels(text) == set()


@pytest.mark.parametrize(
    "text,label",
    [
        ("code released under the mit license", "mit"),
        ("licensed under the mit terms", "mit"),
        ("licensed under the apache license", "apache"),
        ("licensed under the gnu general public license", "gpl"),
    ],
)
def test_named_licences_are_found(text, label):
    assert labels(text) == {label}


def test_short_templates_without_a_name_count_whole():
    own = Scanner({}, [("x", "free for any use here")])
    assert labels("it is free for any use here now", own) == {"x"} and labels("free for any price", own) == set()
