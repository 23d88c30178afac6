"""A made-up dialog, drawn by rule: a picture of known elements for tests, without fonts (texts are bars of ink)."""

from __future__ import annotations

import numpy as np

# Size, themes (canvas, ink, accent) and elements (kind, x, y, w, h) of the dialog.
WIDTH, HEIGHT = 640, 400
THEMES = {"light": ((245, 245, 245), (30, 30, 30), (0, 100, 215)), "dark": ((32, 32, 32), (230, 230, 230), (90, 160, 250))}
ELEMENTS = (
    ("text", 30, 24, 140, 14), ("rect", 30, 60, 260, 120), ("outline", 320, 60, 280, 120), ("radio", 40, 200, 13, 13), ("text", 60, 200, 90, 12),
    ("checkbox", 40, 230, 13, 13), ("text", 60, 230, 90, 12), ("input-field", 200, 200, 380, 24), ("button", 440, 340, 80, 26), ("button", 530, 340, 80, 26),
)


def _frame(picture: np.ndarray, x: int, y: int, w: int, h: int, colour: tuple[int, int, int]) -> None:
    for rows, cols in ((y, slice(x, x + w)), (y + h - 1, slice(x, x + w)), (slice(y, y + h), x), (slice(y, y + h), x + w - 1)):
        picture[rows, cols] = colour


def generate(theme: str = "light") -> tuple[np.ndarray, list[dict]]:
    """The picture (RGB) and the list of its elements."""
    canvas, ink, accent = THEMES[theme]
    picture = np.full((HEIGHT, WIDTH, 3), canvas, np.uint8)
    for kind, x, y, w, h in ELEMENTS:
        if kind in ("rect", "input-field"):
            picture[y : y + h, x : x + w] = accent
        elif kind == "text":
            picture[y : y + h : 2, x : x + w] = ink
        elif kind == "radio":
            ys, xs = np.mgrid[0:h, 0:w]
            picture[y : y + h, x : x + w][np.abs(np.hypot(ys - (h - 1) / 2, xs - (w - 1) / 2) - (w - 2) / 2) < 1] = ink
        else:
            _frame(picture, x, y, w, h, ink)
    return picture, [{"kind": k, "box": [x, y, w, h]} for k, x, y, w, h in ELEMENTS]
