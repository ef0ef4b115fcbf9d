"""Text for formal tools: transition systems, theorem contracts and workflows."""

from __future__ import annotations

import re

from ..language.ast import Declaration, Program
from ..language.declarations import entity, transitions


def _word(text: str) -> str:
    word = re.sub(r"\W+", "_", text).strip("_")
    return word if word and not word[0].isdigit() else f"n{word}"


def _system(d: Declaration) -> tuple[list[str], str, list[dict]]:
    if d.kind != "lts_atom":
        raise ValueError(f"{d.name} is not a transition system")
    states = [v.token() for v in d.get("states").members()]
    return states, d.get("initial").token(), [m for m in transitions(d) if m]


def tla(d: Declaration) -> str:
    """A TLA+ module of an LTS_ATOM."""
    states, initial, moves = _system(d)
    name = _word(d.name)
    steps = [f'{_word(m["label"])}_{i} == state = "{m["from_state"]}" /\\ state\' = "{m["to_state"]}"' for i, m in enumerate(moves)]
    names = " \\/ ".join(s.split(" ")[0] for s in steps) or "FALSE"
    listed = ", ".join(f'"{s}"' for s in states)
    return "\n".join([f"---- MODULE {name} ----", "VARIABLE state", f"States == {{{listed}}}", f'Init == state = "{initial}"', *steps, f"Next == {names}", "TypeOK == state \\in States", "Spec == Init /\\ [][Next]_state", "====", ""])


def lean(d: Declaration) -> str:
    """An inductive step relation of an LTS_ATOM."""
    states, initial, moves = _system(d)
    name = _word(d.name)
    out = [f"namespace {name}", "inductive State where", *[f"  | {_word(s)}" for s in states], "inductive Step : State → String → State → Prop where"]
    out += [f'  | step{i} : Step .{_word(m["from_state"])} "{m["label"]}" .{_word(m["to_state"])}' for i, m in enumerate(moves)]
    return "\n".join([*out, f"def initial : State := .{_word(initial)}", f"end {name}", ""])


def contracts(rows: list[dict]) -> str:
    """One block for each row of ``theorem_audit``: what a theorem assumes, uses and ensures."""
    out = []
    for r in sorted(rows, key=lambda r: r["theorem"]):
        out.append(f"theorem {_word(r['theorem'])}")
        out += [f"  {label} {x}" for label, key in (("assumes", "assumptions"), ("uses", "lemmas"), ("ensures", "guarantees"), ("evidence", "evidence")) for x in r[key]]
        out += [f"  issue {x}" for x in r["issues"]] or ["  ok"]
    return "\n".join(out) + "\n"


def refinements(program: Program) -> str:
    """A line for each REFINES and CORRESPONDS declaration."""
    ends = {"refines": ("impl", "spec"), "corresponds": ("left", "right")}
    return "".join(f"{d.kind}\t{entity(d)}\t{d.get(ends[d.kind][0]).token()}\t{d.get(ends[d.kind][1]).token()}\n" for d in program.declarations if d.kind in ends)


def workflow(observations: list[dict]) -> str:
    """A workflow's observations, in order, as a list of steps."""
    rows = sorted(observations, key=lambda r: r["place"])
    return "\n".join([f"def {_word(rows[0]['workflow_id']) if rows else 'empty'} : List (Nat × String × String) := [", *[f'  ({r["place"]}, "{r["event_type"]}", "{r["actor"]}"),' for r in rows], "]", ""])
