"""Small inputs with known results: the source rules, flows, verifications and readers are held against them."""

from __future__ import annotations

CONTEXT = "#[derive(Accounts)]\npub struct Open<'info> {\n%s\n}\n"

#: (file, source, ids of the findings). One file a case; what is to be found was worked out by hand from the rules.
STATIC = [
    ("pda_static.rs", CONTEXT % "    #[account(seeds = [b\"note\"], bump)]\n    pub note: Account<'info, Note>,\n    pub payer: Signer<'info>,", "PRIV-010"),
    ("pda_variable.rs", CONTEXT % "    #[account(seeds = [b\"note\", user_id], bump)]\n    pub note: Account<'info, Note>,\n    pub payer: Signer<'info>,", "PRIV-010"),
    ("pda_key.rs", CONTEXT % "    #[account(seeds = [b\"note\", who.key().as_ref()], bump)]\n    pub note: Account<'info, Note>,\n    pub payer: Signer<'info>,", ""),
    ("pda_bytes.rs", CONTEXT % "    #[account(seeds = [b\"note\", nonce.to_bytes()], bump)]\n    pub note: Account<'info, Note>,\n    pub payer: Signer<'info>,", ""),
    ("pda_owner.rs", CONTEXT % "    #[account(seeds = [b\"note\", owner], bump)]\n    pub note: Account<'info, Note>,\n    pub payer: Signer<'info>,", ""),
    ("pda_global.rs", CONTEXT % "    #[account(seeds = [b\"config_v2\"], bump)]\n    pub settings: Account<'info, Note>,\n    pub payer: Signer<'info>,", ""),
    ("mut_bare.rs", CONTEXT % "    #[account(mut)]\n    pub note: Account<'info, Note>,", "PRIV-008"),
    ("mut_checked.rs", CONTEXT % "    #[account(mut, has_one = keeper)]\n    pub note: Account<'info, Note>,", ""),
    ("mut_signer.rs", CONTEXT % "    #[account(mut)]\n    pub payer: Signer<'info>,", ""),
    ("mut_long.rs", CONTEXT % ("    #[account(mut)] // " + "a long remark " * 40 + "\n    pub note: Account<'info, Note>, // with a constraint elsewhere"), ""),
    ("read_raw.rs", "fn read(d: &[u8]) {\n    let n = Note::try_from_slice(d);\n}\n", "PRIV-008"),
    ("read_checked.rs", "fn read(d: &[u8]) {\n    // the discriminator comes first\n    let n = Note::try_from_slice(d);\n}\n", ""),
    ("read_anchor.rs", "fn read(d: &[u8]) {\n    let n = Note::try_from_slice(d);\n    let m = Note::try_deserialize(d);\n}\n", ""),
    ("read_account.rs", "fn read(d: &[u8]) {\n    let a = Account::try_from(d);\n    let n = Note::try_from_slice(d);\n}\n", ""),
    ("signer_missing.rs", CONTEXT % "    /// CHECK: held by the program\n    pub authority: UncheckedAccount<'info>,", "PRIV-011"),
    ("signer_has_one.rs", CONTEXT % "    /// CHECK: held by the program\n    pub authority: UncheckedAccount<'info>,\n    // has_one elsewhere", ""),
    ("unchecked.rs", CONTEXT % "    pub feed: UncheckedAccount<'info>,", "PRIV-012"),
    ("unchecked_said.rs", CONTEXT % "    /// CHECK: read only\n    pub feed: UncheckedAccount<'info>,", ""),
    ("call_open.rs", "fn go() {\n    invoke(&ix, &accounts)?;\n" + "    step();\n" * 8 + "}\n", "PRIV-009,PRIV-013"),
    ("call_known.rs", "fn go() {\n    invoke(&spl_token::instruction::transfer(), &accounts)?;\n" + "    step();\n" * 8 + "}\n", "PRIV-013"),
    ("call_system_program.rs", "fn go() {\n    let p = system_program;\n    invoke(&ix, &accounts)?;\n" + "    step();\n" * 8 + "}\n", "PRIV-009"),
    ("call_self.rs", "fn go() {\n    invoke(&self.swap_instruction, &accounts)?;\n" + "    step();\n" * 8 + "}\n", "PRIV-013"),
    ("call_short.rs", "fn go() {\n    invoke(&program_id, &accounts)?;\n}\n", ""),
    ("close_open.rs", "#[account(close = payer)]\n", "PRIV-014"),
    ("close_cleared.rs", "#[account(close = payer)]\n// is_initialized is reset\n", ""),
    ("init_again.rs", "#[account(init_if_needed, payer = payer)]\n", "PRIV-015"),
    ("init_guarded.rs", "#[account(init_if_needed, payer = payer, constraint = note.fresh)]\n", ""),
    ("math_open.rs", "fn sum() {\n    let t = balance + 1;\n}\n", "PRIV-016"),
    ("math_checked.rs", "fn sum() {\n    let t = balance + x.checked_add(1);\n}\n", ""),
    ("log_word.rs", "fn say() {\n    msg!(\"secret {}\", p);\n}\n", "PRIV-006"),
    ("log_print.rs", "fn say() {\n    println!(\"x\");\n}\n", "PRIV-007"),
    ("log_cfg_use.rs", "#[cfg(test)]\nuse helper;\nfn say() {\n    println!(\"x\");\n}\n", "PRIV-007"),
    ("log_cfg_mod.rs", "#[cfg(test)]\nmod inner {\nfn say() {\n    println!(\"x\");\n}\n}\n", ""),
    ("log_debug_mod.rs", "#[cfg(debug_assertions)]\npub mod inner {\nfn say() {\n    println!(\"x\");\n}\n}\n", ""),
    ("emit_word.rs", "fn say() {\n    emit!(Moved {\n        owner: e,\n    });\n}\n", "PRIV-006"),
    ("pii_email.rs", "#[account]\npub struct UserProfile {\n    pub email: String,\n}\n", "PRIV-004"),
    ("pii_hash.rs", "#[account]\npub struct Vote {\n    pub email_hash: [u8; 32],\n}\n", ""),
    ("secret_field.rs", "#[account]\npub struct Vault {\n    pub mnemonic: String,\n}\n", "PRIV-005"),
    ("quiet_line.rs", "fn say() {\n    println!(\"x\"); // privacy-ignore\n}\n", ""),
    ("quiet_rule.rs", "fn say() {\n    println!(\"x\"); // privacy-ignore [PRIV-006]\n}\n", "PRIV-007"),
    ("quiet_next.rs", "fn say() {\n    // privacy-ignore-next-line\n    println!(\"x\");\n    println!(\"y\");\n}\n", "PRIV-007"),
    ("quiet_file.rs", "// privacy-ignore-file [PRIV-007]\nfn say() {\n    println!(\"x\");\n}\n", ""),
    ("mock_print.rs", "fn say() {\n    println!(\"x\");\n}\n", ""),
]

#: (file, source, flows as line:sink:source kind:carrier:confidence).
FLOWS = [
    ("param.rs", "pub fn f(note: String) {\n    msg!(\"{}\", note);\n}\n", "2:msg:parameter:note:80"),
    ("bytes.rs", "pub fn f(blob: Vec<u8>) {\n    msg!(\"{:?}\", blob);\n}\n", "2:msg:parameter:blob:90"),
    ("personal.rs", "pub fn f(user_email: String) {\n    emit!(Made { user_email });\n}\n", "2:emit:parameter:user_email:95"),
    ("generic.rs", "pub fn f(label: String) {\n    msg!(\"{}\", label);\n}\n", "2:msg:parameter:label:55"),
    ("plain_name.rs", "pub fn f(data: String) {\n    msg!(\"{}\", data);\n}\n", "2:msg:parameter:data:80"),
    ("hashed.rs", "pub fn f(note: String) {\n    let h = hash(note);\n    msg!(\"{:?}\", h);\n}\n", ""),
    ("length.rs", "pub fn f(note: String) {\n    msg!(\"{}\", note.len());\n}\n", ""),
    ("known.rs", "pub fn f(note: String) {\n    msg!(\"{}\", note.is_empty());\n}\n", ""),
    ("safe_type.rs", "pub fn f(n: u64) {\n    msg!(\"{}\", n);\n}\n", ""),
    ("moved.rs", "pub fn f(note: String) {\n    let b = note;\n    let c = b;\n    emit!(Made { c });\n}\n", "4:emit:parameter:c:85"),
    ("account.rs", "pub fn f(ctx: Context<A>) {\n    let h = ctx.accounts.holder;\n    msg!(\"{}\", h);\n}\n", "3:msg:account:h:85"),
    ("own.rs", "pub fn g(x: u64) -> u64 {\n    x\n}\npub fn f(n: u64) {\n    let r = g(n);\n    msg!(\"{}\", r);\n}\n", ""),
    ("other.rs", "pub fn f(n: u64) {\n    let r = far(n);\n    msg!(\"{}\", r);\n}\n", "3:msg:call:r:75"),
    ("zfar.rs", "pub fn far(x: Vec<u8>) -> Vec<u8> {\n    x\n}\n", ""),
    ("zown.rs", "pub fn g(x: Vec<u8>) -> Vec<u8> {\n    x\n}\n", ""),
]

ADDRESS = "9W959DqEETiGZocYWCQPaJ6sBmUzgfxXfqGeTEdp3aQP"
OTHER = "4Nd1mBQtrMJVYVfKf2PJy9NZUZdTAsp7D4xWLs4gDB4T"

#: (snippet of a PRIV-009 finding, adjustment, note)
TARGETS = [
    ("call of (TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA)", -20, "target is a known safe program"),
    (f"invoke {ADDRESS},", 25, "target can be upgraded"),
    (f"invoke {OTHER}", -15, "target is frozen"),
    ("invoke So11111111111111111111111111111111111111112", 0, "target program not found"),
    ("invoke(&ix)", 0, "no address in the finding"),
]
#: (program, owner, exists)
PROGRAMS = [
    ("TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "BPFLoader2111111111111111111111111111111111", True),
    (ADDRESS, "BPFLoaderUpgradeab1e11111111111111111111111", True),
    (OTHER, "BPFLoader2111111111111111111111111111111111", True),
]
#: (program, owner, exists, enumerable, static confidence, verified confidence)
GENERIC = [
    ("TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", None, True, 0, 80, 55), ("absent", None, False, 0, 80, 60), ("plain", None, True, 50, 70, 90),
    ("frozen", "BPFLoader2111111111111111111111111111111111", True, 100, 70, 75), ("So1endDq2YkqhipRh3WViPa8hdiSpxWy6z3Z6tMCpAo", "BPFLoader2111111111111111111111111111111111", False, 0, 30, 5),
]
#: Logs of one transaction, and (rule, static confidence, verified confidence).
LOGS = ["user john@mail.example 555-123-4567", "debug: x", "missing discriminator", "predictable seed", "derived pda user1"]
VERIFIED = [("PRIV-002", 80, 65), ("PRIV-006", 80, 95), ("PRIV-007", 80, 90), ("PRIV-008", 80, 90), ("PRIV-009", 80, 70), ("PRIV-010", 80, 100), ("PRIV-099", 80, 80)]
#: (name, text, result) of helpers of values.
VALUES = [
    ("first_address", f"at ({ADDRESS}), now", ADDRESS), ("first_address", "no address", None), ("field_value", '{"name": "A B"}', "A B"), ("field_value", '{"nam": "A"}', None),
    ("payload_size", "A" * 88, "66"), ("payload_size", "", "0"), ("has_name", "let name = 1", "true"), ("has_name", "let my_name = 1", "false"), ("account_pii", "am9obkBleGFtcGxlLmNvbQ==", "true"),
    ("account_pii", "not base64", None), ("safe_value", "BONK", "true"), ("safe_value", "John Smith", "false"), ("tx_context", "SWAP|a swap in a pool", "swap swap pool"), ("tx_context", "NONE|nothing", "none"),
]
#: What the two sample files hold: (file, line, source kind, sink, carrier, confidence) of flows, (id, file, line, confidence) of findings.
SAMPLE_FLOWS = [
    ("quiet.rs", 11, "parameter", "msg", "name", 80), ("quiet.rs", 12, "parameter", "debug", "name", 60), ("vault.rs", 8, "parameter", "msg", "memo", 80),
    ("vault.rs", 12, "account", "emit", "holder", 90), ("vault.rs", 19, "input", "msg", "record", 95), ("vault.rs", 20, "input", "cpi", "record", 98),
]
SAMPLE_FINDINGS = [
    ("PRIV-003", "quiet.rs", 2, 88), ("PRIV-007", "quiet.rs", 12, 80), ("PRIV-030", "quiet.rs", 12, 60), ("PRIV-006", "vault.rs", 8, 80), ("PRIV-030", "vault.rs", 8, 80), ("PRIV-006", "vault.rs", 12, 55),
    ("PRIV-030", "vault.rs", 12, 90), ("PRIV-008", "vault.rs", 18, 75), ("PRIV-030", "vault.rs", 19, 95), ("PRIV-009", "vault.rs", 20, 80), ("PRIV-013", "vault.rs", 20, 60), ("PRIV-030", "vault.rs", 20, 98),
    ("PRIV-008", "vault.rs", 27, 70), ("PRIV-010", "vault.rs", 30, 80), ("PRIV-012", "vault.rs", 31, 55), ("PRIV-004", "vault.rs", 36, 85), ("PRIV-004", "vault.rs", 37, 98), ("PRIV-004", "vault.rs", 38, 98), ("PRIV-005", "vault.rs", 40, 98),
]
#: (file, line, delta) of lines of the two files of CONTEXT_FILES.
CONTEXT_FILES = [("a.rs", "#[account]\npub struct P {\n    pub note: String,\n}\n"), ("b.rs", "#[test]\nfn t() {\n    require!(x);\n    todo();\n}\n")]
DELTAS = [("a.rs", 1, 15), ("a.rs", 2, 15), ("a.rs", 3, 15), ("a.rs", 4, 15), ("b.rs", 1, -60), ("b.rs", 2, -60), ("b.rs", 3, -60), ("b.rs", 4, -60), ("b.rs", 5, -60)]
#: Accounts (lamports, size), memos, and findings (id, snippet).
BARE = ([(0, 10), (5, 0), (5, 100)], ["a Secret note", "cold wallet", "plain", None], [("PRIV-008", "2 accounts with zero lamports/data"), ("PRIV-006", "2 transactions with sensitive memos")])


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a constant table."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"
