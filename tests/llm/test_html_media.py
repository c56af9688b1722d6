"""Rules for other media than a screen hide nothing."""

import pytest

from tensorfold.llm import html_text


@pytest.mark.parametrize(
    "sheet",
    [
        "<style>@media print { .x { display:none } }</style>",
        "<style>@media (max-width: 600px) { p { color: red } .x { display:none } } .y { display:none }</style>",
        "<style>@supports (display: grid) { @media print { .x { display:none } } }</style>",
        "<style media=print>.x { display:none }</style>",
    ],
)
def test_other_media_hide_nothing(sheet):
    assert html_text.render(f"{sheet}<p class=x>yes</p>") == "yes"


def test_screen_rules_still_hide():
    for sheet in ("<style media='print, screen'>.x{display:none}</style>", "<style>@media screen { .x { display:none } }</style>", "<style>@media print { p { color: red } } .x { display:none }</style>"):
        assert html_text.render(f"{sheet}<p class=x>no</p>yes") == "yes"
