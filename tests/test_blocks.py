import random

import pyarrow as pa
import pytest
from test_workbooks import NS, sheet

from gridloom.options import make_options
from gridloom.sources import frames, xlsx
from gridloom.sources.blocks import Block
from gridloom.sources.frames import column_type, decoded, describe, row_decoder

STYLES = f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/><numFmt numFmtId="165" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
STRINGS = f"<sst {NS}><si><t>shared &amp; one</t></si><si><t></t></si><si><t>two</t></si></sst>"


def cell(draw, kind, empties):
    if draw.random() < empties:
        return "<c/>"
    if kind == "long":
        return f'<c t="n"><v>{draw.choice([0, -7, 12, 10**17, 46233])}</v></c>'
    if kind == "double":
        return f'<c t="n"><v>{draw.choice(["1.5", "2", "1e5", "-0.25", "123456789.125", "007"])}</v></c>'
    if kind == "odd":
        return f'<c t="n"><v>{draw.choice(["9223372036854775808", " 5 ", "+3", ".5", "x"])}</v></c>'
    if kind == "date":
        return f'<c s="1" t="n"><v>{draw.choice(["46233", "46233.5", "59", "0.25", "1"])}</v></c>'
    if kind == "time":
        return f'<c s="2" t="n"><v>{draw.choice(["0.5", "0.25"])}</v></c>'
    if kind == "bool":
        return f'<c t="b"><v>{draw.choice("01")}</v></c>'
    if kind == "shared":
        return f'<c t="s"><v>{draw.choice("0129")}</v></c>'
    if kind == "mixed":
        return cell(draw, draw.choice(["double", "text", "date", "bool"]), 0).replace("123456789.125", "3.5")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{draw.choice(["a", " b ", "&lt;&amp;&#233;", "é", "", "46233"])}</t></is></c>'


@pytest.mark.parametrize("seed", range(60))
def test_blocks_and_rows_agree(spark, monkeypatch, seed):
    draw = random.Random(seed)
    kinds = [draw.choice(["long", "double", "odd", "date", "time", "bool", "shared", "text", "text", "mixed"] if seed % 2 else ["long", "double", "date", "bool", "shared", "text"]) for _ in range(draw.randrange(1, 6))]
    empties = draw.choice([0, 0, 0.2, 0.9])
    body = "".join("<row>" + "".join(cell(draw, k, empties) for k in kinds) + "</row>" for _ in range(40))
    head = "<row>" + "".join(f'<c t="inlineStr"><is><t>h{i}</t></is></c>' for i in range(len(kinds))) + "</row>"
    content = sheet(head + " " * 64 + body, **{"xl/styles.xml": STYLES, "xl/sharedStrings.xml": STRINGS})
    groups = xlsx.element_groups

    def parts(source, name):
        """The header alone, then the rows, as if a group ended there."""
        for group, parse in groups(source, name):
            cut = group.find(b"</row>") + 6
            yield group[:cut], lambda: [e for e in parse() if True][:1]
            yield group[cut:].lstrip(), lambda: parse()[1:]

    monkeypatch.setattr(xlsx, "element_groups", parts)
    for options in (make_options(assoc=True), make_options(assoc=True, stringify_values=False), make_options(assoc=True, stringify_values=False, columns=["h0"]), make_options(assoc=True, stringify_values=False, skip_empty_lines=False)):
        rows = list(decoded(content, "xlsx", options).rows)
        said = describe(content, "xlsx", options, True)
        if seed % 2 == 0 and empties == 0 and kinds[0] in ("long", "date"):
            assert any(isinstance(r, Block) for r in decoded(content, "xlsx", options, blocks=True).rows)
        picked = said["header"]["indices"]
        want = {i: {frames._kind(r[i]) for r in rows if i < len(r) and r[i] is not None and r[i] != ""} for i in picked}
        types = ["string" if options.stringify_values else column_type(set(said["kinds"].get(str(i), []))) for i in picked]
        assert types == ["string" if options.stringify_values else column_type(want[i]) for i in picked]
        header = decoded(content, "xlsx", options).header
        run, _ = row_decoder("xlsx", options, None, types, header)
        batch = pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([content], pa.binary())], names=["path", "content"])
        got = pa.Table.from_batches(list(run(iter([batch]))) or [], None) if rows else None
        columns = [frames._converted([r[i] if i < len(r) else None for r in rows], k).to_pylist() for i, k in zip(picked, types)]
        assert rows == [] or [got.column(i + 2).to_pylist() for i in range(len(picked))] == columns and got.column(1).to_pylist() == list(range(len(rows)))
