"""Office math markup to LaTeX. The input is a tree, so this is a recursive function over the parsed part."""

from __future__ import annotations

from ..sources.xml import Node

# Accents and large operators by their characters.
ACCENTS = {"̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overline", "̇": "dot", "̈": "ddot", "⃗": "vec", "̌": "check"}
OPERATORS = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∬": "\\iint", "∭": "\\iiint", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap", "∐": "\\coprod"}
FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "lim", "max", "min", "exp", "det", "gcd", "sup", "inf", "arg", "dim", "ker"}


def _value(node: Node, *path: str) -> str | None:
    found = node.first(*path)
    return found.get("m:val") if found is not None else None


def _part(node: Node, name: str) -> str:
    found = node.first(name)
    return latex(found) if found is not None else ""


def latex(node: Node) -> str:
    """The LaTeX of a math element's children; unknown elements give their text."""
    return "".join(_one(c) for c in node.nodes())


def _one(node: Node) -> str:
    name = node.name.removeprefix("m:")
    sub, sup, e = (lambda: _part(node, "m:sub")), (lambda: _part(node, "m:sup")), (lambda: _part(node, "m:e"))
    match name:
        case "r":
            return "".join(t.text() for t in node.nodes("m:t"))
        case "f":
            bar = _value(node, "m:fPr", "m:type")
            num, den = _part(node, "m:num"), _part(node, "m:den")
            return f"{num}/{den}" if bar == "lin" else f"\\binom{{{num}}}{{{den}}}" if bar == "noBar" else f"\\frac{{{num}}}{{{den}}}"
        case "sSup":
            return f"{{{e()}}}^{{{sup()}}}"
        case "sSub":
            return f"{{{e()}}}_{{{sub()}}}"
        case "sSubSup":
            return f"{{{e()}}}_{{{sub()}}}^{{{sup()}}}"
        case "rad":
            degree = _part(node, "m:deg")
            return f"\\sqrt[{degree}]{{{e()}}}" if degree else f"\\sqrt{{{e()}}}"
        case "d":
            left, right, mark = (_value(node, "m:dPr", f"m:{x}") for x in ("begChr", "endChr", "sepChr"))
            inside = (mark or ",").join(latex(x) for x in node.nodes("m:e"))
            side = {"{": "\\{", "}": "\\}", "": "."}
            left, right = "(" if left is None else left, ")" if right is None else right
            return f"\\left{side.get(left, left)} {inside} \\right{side.get(right, right)}"
        case "nary":
            sign = _value(node, "m:naryPr", "m:chr") or "∫"
            low, high = sub(), sup()
            return OPERATORS.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f" {e()}"
        case "m":
            rows = " \\\\ ".join(" & ".join(latex(x) for x in row.nodes("m:e")) for row in node.nodes("m:mr"))
            return f"\\begin{{matrix}} {rows} \\end{{matrix}}"
        case "eqArr":
            return "\\begin{aligned} " + " \\\\ ".join(latex(x) for x in node.nodes("m:e")) + " \\end{aligned}"
        case "func":
            label = _part(node, "m:fName")
            return (f"\\{label}" if label in FUNCTIONS else label) + f"{{{e()}}}"
        case "limLow":
            return f"\\underset{{{_part(node, 'm:lim')}}}{{{e()}}}"
        case "limUpp":
            return f"\\overset{{{_part(node, 'm:lim')}}}{{{e()}}}"
        case "bar":
            return f"\\underline{{{e()}}}" if _value(node, "m:barPr", "m:pos") == "bot" else f"\\overline{{{e()}}}"
        case "acc":
            return f"\\{ACCENTS.get(_value(node, 'm:accPr', 'm:chr') or chr(0x302), 'hat')}{{{e()}}}"
        case "groupChr":
            return f"\\overbrace{{{e()}}}" if _value(node, "m:groupChrPr", "m:pos") == "top" else f"\\underbrace{{{e()}}}"
        case _ if name.endswith("Pr"):
            return ""
        case _:
            return latex(node) or node.text()


def formula(node: Node) -> str:
    """LaTeX, else the flattened text, else a placeholder."""
    return latex(node).strip() or node.text().strip() or "[equation]"
