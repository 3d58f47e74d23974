"""Labels as text in four styles and back: tuples, sentences, typed lines, dictionaries.

Writing is by Column expressions; reading is one Arrow-batched function, as dictionaries and repair need it.
A kind's fields are in the order in which tuples hold them.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = "NAN"
TUPLE, SENTENCE, LINE, DICT = range(4)
FIELDS = {"entity": ("entity", "entity_type"), "relation": ("head", "relation", "tail"), "trigger": ("event_trigger", "event_type")}
#: The field that names the type of a label: labels without one are left out.
KIND = {"entity": "entity_type", "trigger": "event_type"}

# The sentences of each kind and language, and the answers that mean that nothing was found.
SENTENCES = {
    "zh": {"entity": "实体是{entity},实体类型是{entity_type}", "relation": "头实体是{head},关系是{relation},尾实体是{tail}", "trigger": "事件触发词是{event_trigger},事件类型是{event_type}", "argument": "事件论元是{argument},论元角色是{role}"},
    "en": {"entity": "Entity is {entity},Entity Type is {entity_type}", "relation": "Subject is {head},Relation is {relation},Object is {tail}", "trigger": "Event Trigger is {event_trigger},Event Type is {event_type}", "argument": "Argument is {argument},Argument Role is {role}"},
}
REFUSALS = ("No entity found.", "No relation found.", "No event found.")


def filled(template: str, label: Column) -> Column:
    """The template with the label's fields in the places {field}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(label[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def quoted(c: Column) -> Column:
    """A text as a Python string literal."""
    c = F.coalesce(c, F.lit(""))
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    single = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(single)


def one_line(kind: str, style: int, language: str, label: Column) -> Column:
    names = FIELDS[kind]
    if style == TUPLE:
        return F.concat(F.lit("("), F.concat_ws(",", *[label[n] for n in names]), F.lit(")"))
    if style == SENTENCE:
        return filled(SENTENCES[language][kind], label)
    if style == LINE:
        return filled("{relation}：{head},{tail}" if kind == "relation" else f"{{{names[1]}}}：{{{names[0]}}}", label)
    colon = "':" if kind == "trigger" else "': "
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{n}{colon}"), quoted(label[n])) for n in names]), F.lit("}"))


def joined(lines: Column, separator: str = "\n") -> Column:
    """The lines as a text; one NAN, where all are NAN or there is none."""
    return F.when(F.exists(lines, lambda x: x != NAN), F.array_join(lines, separator)).otherwise(F.lit(NAN))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def written(labels: Column, kind: str, style: int, language: str = "zh") -> Column:
    """Labels as text, a line each: NAN for one with an empty field; those of an empty type go (relations: NAN)."""
    kept = F.filter(labels, lambda l: ~blank(l[KIND[kind]])) if kind in KIND else labels
    return joined(F.transform(kept, lambda l: F.when(reduce(lambda a, b: a | b, [blank(l[n]) for n in FIELDS[kind]]), F.lit(NAN)).otherwise(one_line(kind, style, language, l))))


def written_events(events: Column, style: int, language: str = "zh") -> Column:
    """Events (event_trigger, event_type, arguments of (argument, role)) as text: arguments joined by semicolons, NAN for an empty one and for none.

    Events without a type and arguments without a role go; an event without a trigger is NAN.
    """

    def argument(a: Column) -> Column:
        if style == SENTENCE:
            text = filled(SENTENCES[language]["argument"], a)
        elif style == DICT:
            text = F.concat(F.lit("{'argument':"), quoted(a["argument"]), F.lit(", 'role':"), quoted(a["role"]), F.lit("}"))
        else:
            text = F.concat(a["role"], F.lit("#" if style == TUPLE else "："), a["argument"])
        return F.when(blank(a["argument"]), F.lit(NAN)).otherwise(text)

    def event(e: Column) -> Column:
        args = F.transform(F.filter(e["arguments"], lambda a: ~blank(a["role"])), argument)
        text = F.when(F.coalesce(F.size(args), F.lit(0)) < 1, F.lit(NAN)).otherwise(F.array_join(args, "," if style == DICT else ";"))
        if style == DICT:
            return F.concat(F.lit("{'event_trigger':"), quoted(e["event_trigger"]), F.lit(", 'event_type':"), quoted(e["event_type"]), F.lit(", 'arguments':("), text, F.lit(")}"))
        if style == TUPLE:
            return F.concat(F.lit("("), e["event_trigger"], F.lit(","), e["event_type"], F.lit(","), text, F.lit(")"))
        return F.concat(one_line("trigger", style, language, e), F.lit("\n"), text)

    kept = F.filter(events, lambda e: ~blank(e["event_type"]))
    lines = F.transform(kept, lambda e: F.when(blank(e["event_trigger"]), F.lit(NAN)).otherwise(event(e)))
    return joined(lines, "\n" if style in (TUPLE, DICT) else "\n\n")


# Reading --------------------------------------------------------------------------------------------------------------


def template_pattern(template: str) -> re.Pattern:
    """A template as a pattern with a group for each field; all but the last are as short as can be."""
    parts = re.split(r"\{(\w+)\}", template)
    last = len(parts) - 2
    return re.compile("".join((f"(?P<{p}>.*)" if i == last else f"(?P<{p}>.*?)") if i % 2 else re.escape(p) for i, p in enumerate(parts)), re.S)


def sniffed(text: str, kind: str, language: str) -> int:
    """The style a text seems to have: dictionary, sentence, tuple, else typed line."""
    first = SENTENCES[language]["trigger" if kind == "event" else kind].split("{")[0]
    return DICT if "{'" in text or '{"' in text else SENTENCE if first in text else TUPLE if text.lstrip().startswith("(") else LINE


def repaired(parts: list[str], source: str | None) -> list[str] | None:
    """Three fields of more than three parts: the longest head, then the longest tail, that the source text holds, with a middle left. None where no cut fits."""
    if len(parts) == 3:
        return parts
    if len(parts) < 3 or not source:
        return None
    for i in range(len(parts) - 2, 0, -1):
        if (head := ",".join(parts[:i]).strip()) in source:
            for j in range(i + 1, len(parts)):
                if (tail := ",".join(parts[j:]).strip()) in source:
                    return [head, ",".join(parts[i:j]), tail]
    return None


def dictionary(text: str) -> dict | None:
    """A dictionary literal whose values are texts or dictionaries in brackets; bare names such as NAN count as empty. None where it is none."""
    try:
        node = ast.parse(text, mode="eval").body
        if not isinstance(node, ast.Dict):
            return None
        out = {}
        for k, v in zip(node.keys, node.values):
            parts = v.elts if isinstance(v, (ast.Tuple, ast.List)) else [v]
            values = [ast.literal_eval(x) for x in parts if not isinstance(x, ast.Name)]
            out[ast.literal_eval(k)] = values if any(isinstance(x, ast.Dict) for x in parts) else "".join(map(str, values))
        return out
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def line_fields(line: str, kind: str, style: int, language: str, source: str | None) -> list[str] | None:
    names = FIELDS[kind]
    if style == DICT:
        d = dictionary(line)
        return None if d is None else [str(d.get(n, "")) for n in names]
    if style == SENTENCE:
        m = template_pattern(SENTENCES[language][kind]).fullmatch(line)
        return [m[n].strip() for n in names] if m else None
    if style == TUPLE:
        if not (line.startswith("(") and line.endswith(")")):
            return None
        parts = line[1:-1].split(",")
        fields = repaired(parts, source) if kind == "relation" else [",".join(parts[:-1]), parts[-1]] if len(parts) >= 2 else None  # a type holds no comma
        return fields and [f.strip() for f in fields]
    named, sign, rest = line.partition("：")
    if not sign:
        return None
    if kind != "relation":
        return [rest.strip(), named.strip()]
    parts = rest.split(",")
    if len(parts) == 2:
        return [parts[0].strip(), named.strip(), parts[1].strip()]
    cut = next((i for i in range(len(parts) - 1, 0, -1) if source and ",".join(parts[:i]) in source and ",".join(parts[i:]) in source), None)
    return [",".join(parts[:cut]), named.strip(), ",".join(parts[cut:])] if cut else None


def event_argument(text: str, style: int, language: str) -> list[str] | None:
    if style == SENTENCE:
        m = template_pattern(SENTENCES[language]["argument"]).fullmatch(text)
        return [m["argument"].strip(), m["role"].strip()] if m else None
    role, sign, argument = text.partition("#" if style == TUPLE else "：")
    return [argument.strip(), role.strip()] if sign else None


def read_event(block: str, style: int, language: str) -> list[list[str]] | None:
    """An event's fields, then its arguments (argument, role); None where it can't be read."""
    if style == DICT:
        head = line_fields(block, "trigger", style, language, None)
        if head is None:
            return None
        args = (dictionary(block) or {}).get("arguments") or []
        return [head] + [[str(a.get("argument", "")), str(a.get("role", ""))] for a in args if isinstance(a, dict)]
    if style == TUPLE:
        if not (block.startswith("(") and block.endswith(")")):
            return None
        parts = block[1:-1].split(",", 2)
        head, rest = ([p.strip() for p in parts[:2]], parts[2] if len(parts) > 2 else "") if len(parts) > 1 else (None, "")
    else:
        first, _, rest = block.partition("\n")
        head = line_fields(first.strip(), "trigger", style, language, None)
    if head is None:
        return None
    return [head] + [a for x in rest.split(";") if x.strip() not in ("", NAN) and (a := event_argument(x.strip(), style, language))]


def read(text: str | None, kind: str, language: str = "zh", source: str | None = None, refusals: tuple[str, ...] = REFUSALS) -> tuple[bool, list]:
    """(ok, labels) of a text of any style: field lists, for kind ``event`` lists of an event's fields and its arguments.

    Refusals, NAN and empty texts hold no labels and are ok. A text is not ok if none of its lines can be read; null is not ok.
    """
    if text is None:
        return False, []
    text = text.strip()
    if not text or text == NAN or any(r in text for r in refusals):
        return True, []
    style = sniffed(text, kind, language)
    if kind == "event":
        lines = text.split("\n\n") if style in (SENTENCE, LINE) else text.split("\n")
        found = [read_event(x.strip(), style, language) for x in lines if x.strip() not in ("", NAN)]
    else:
        found = [line_fields(x.strip(), kind, style, language, source) for x in text.split("\n") if x.strip() not in ("", NAN)]
    labels = [x for x in found if x is not None]
    return bool(labels) or not found, labels


def read_labels(text: Column, kind: str, source: Column | None = None, language: str = "zh", refusals: tuple[str, ...] = REFUSALS) -> Column:
    """``read`` as a struct (ok, labels): labels are arrays of fields; of events the arrays (trigger, type, argument, role, argument, role...)."""

    @F.pandas_udf("ok boolean, labels array<array<string>>")
    def run(s: pd.Series, src: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(s, src):
            ok, labels = read(x, kind, language, y, refusals)
            out.append({"ok": ok, "labels": [[f for part in l for f in part] for l in labels] if kind == "event" else labels})
        return pd.DataFrame(out, columns=["ok", "labels"])

    return run(text, F.lit("") if source is None else source)
