"""Small hand-made inputs for flows that no table has an analogue for: source files and transcript stores."""

from __future__ import annotations

SOURCES = {
    "src/shop/models.py": 'import json\nfrom dataclasses import dataclass\n\n__all__ = ["Item", "LIMIT"]\n\nLIMIT = 3\n\n\n@dataclass\nclass Item:\n    name: str\n\n    def label(self) -> str:\n        return json.dumps(self.name)\n\n\ndef hidden():\n    return globals()\n',
    "src/shop/api.py": "from . import models\nfrom shop.models import Item, LIMIT\n\n\nasync def fetch(n=LIMIT):\n    return Item(str(n))\n",
    "tests/test_api.py": "import shop.api\n\n\ndef test_fetch():\n    assert shop.api.fetch\n",
    "src/core/mod.rs": 'pub mod store;\npub(crate) const fn limit() -> usize { 3 }\nstatic mut COUNT: u32 = 0;\n#[derive(Debug)] pub struct Key { id: u64 }\nextern "C" fn raw() {}\n',
    "src/core/store.rs": 'use crate::core::{limit, Key};\n\n/* fn not_one() {} */\nimpl Key {\n    pub fn id(&self) -> u64 { self.id }\n    fn text(&self) -> &str { "}" }\n}\n',
    "lib/model.dart": "enum Kind { a, b }\n\nclass Model {\n  Model(this.n);\n  final int n;\n  int twice() => n * 2;\n}\n",
    "lib/my_model.dart": "import 'model.dart';\n\nString _name(Model m) => 'x';\n",
    "lib/page.dart": "import 'package:shop/model.dart';\n\nclass Page extends StatelessWidget {\n  const Page({super.key});\n  Widget build(BuildContext c) {\n    return Text('{');\n  }\n}\n",
    "web/card.tsx": "import React, { useState } from 'react';\nimport { price } from './util';\nimport \"./style\";\n\nexport function Card() {\n  const [n, setN] = useState(0);\n  return <b>{price(n)}</b>;\n}\n",
    "web/util.ts": "export const price = (n: number) => n * 2;\nexport type Id = string;\nenum Color { Red }\nconst LIMIT = 3;\n",
}

#: Lines of two transcripts of the first kind of store: blank and malformed lines, a null, a tool result, a dropped record.
STORE1 = {
    "proj-a/s1.jsonl": [
        '{"type":"summary","x":1}',
        "",
        "not json",
        "null",
        '{"type":"user","uuid":"u1","timestamp":"2024-01-01T10:00:00Z","cwd":"/work/shop","message":{"content":"  hello there\\u00a0"}}',
        '{"type":"assistant","uuid":"a1","timestamp":"2024-01-01T10:01:00Z","message":{"content":[{"type":"thinking","text":"hm"},{"type":"text","text":"one"},{"type":"text","text":"two"}]}}',
        '{"type":"user","uuid":"u2","timestamp":"2024-01-01T10:05:00Z","message":{"content":[{"type":"tool_result","text":"no"}]}}',
    ],
    "proj-a/agent-x.jsonl": ['{"type":"user","uuid":"z","timestamp":"2024-01-01T10:00:00Z","message":{"content":"skip me"}}'],
    "proj-b/s2.jsonl": ['{"type":"assistant","uuid":"b1","message":{"content":"no time"}}'],
}

#: Lines of transcripts of the second kind of store: two roots' folders, a file without "_", a folder with a dot, no header, blocks, a dropped role.
STORE2 = {
    "--work-shop--/2024-01-02T09-00-00_abc.jsonl": [
        '{"type":"session","cwd":"/work/shop"}',
        '{"type":"message","id":"m1","timestamp":"2024-01-02T09:00:00Z","message":{"role":"user","content":" hi "}}',
        '{"type":"message","id":"m2","timestamp":"2024-01-02T09:01:00Z","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}}',
        '{"type":"message","id":"m3","timestamp":"2024-01-02T09:02:00Z","message":{"role":"tool","content":"x"}}',
    ],
    "--home-me--/2024-01-03T09-00-00_d_e.jsonl": ['{"type":"message","id":"k","timestamp":"2024-01-03T09:00:00Z","message":{"role":"user","content":"alone"}}', '{"type":"message","timestamp":"2024-01-03T09:05:00Z","message":{"role":"user","content":"   "}}'],
    "--work-shop--/nounderscore.jsonl": ['{"type":"message","id":"m","timestamp":"2024-01-02T09:00:00Z","message":{"role":"user","content":"no"}}'],
    ".hidden/2024_x.jsonl": ['{"type":"message","id":"m","timestamp":"2024-01-02T09:00:00Z","message":{"role":"user","content":"no"}}'],
}

#: Rollouts of the third kind of store, and rows of its thread table: (id, file, title, first_user_message, cwd, created_at, updated_at).
STORE3 = {
    "d/one.jsonl": [
        '{"type":"session_meta","payload":{}}',
        '{"type":"event_msg","timestamp":"2024-01-04T10:00:00Z","payload":{"type":"user_message","message":" start "}}',
        '{"type":"event_msg","timestamp":"2024-01-04T10:10:00Z","payload":{"type":"agent_message","message":"done"}}',
        '{"type":"event_msg","payload":{"type":"token_count","message":"no"}}',
    ],
    "d/empty.jsonl": ['{"type":"session_meta","payload":{}}'],
}
THREADS = (("t1", "d/one.jsonl", "", " first question ", "/w/p", 1704067200, 1704240000), ("t2", "d/empty.jsonl", "x", "", "", 1, 1), ("t3", "d/none.jsonl", "x", "", "", 1, 1), ("t4", None, "x", "", "", 1, 1))
