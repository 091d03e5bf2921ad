"""Small inputs of our own, for queries and tests of operators whose inputs are source files or ledger JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

VAULT = '''use anchor_lang::prelude::*;

#[program]
pub mod vault {
    use super::*;

    pub fn deposit(ctx: Context<Deposit>, memo: String, amount: u64) -> Result<()> {
        msg!("deposit by user {}", memo);
        let holder = &ctx.accounts.holder;
        let tag = hash(memo.as_bytes());
        msg!("tag {:?}", tag);
        emit!(Deposited { user: holder.owner, amount });
        let total = amount + 1;
        Ok(())
    }

    pub fn restore(data: Vec<u8>) -> Result<()> {
        let record = Record::try_from_slice(&data)?;
        msg!("record {:?}", record);
        invoke(&transfer_to(record), &[])?;
        Ok(())
    }
}

#[derive(Accounts)]
pub struct Deposit<'info> {
    #[account(mut)]
    pub holder: Account<'info, Holder>,
    #[account(seeds = [b"ledger"], bump)]
    pub book: Account<'info, Book>,
    pub authority: AccountInfo<'info>,
    pub payer: Signer<'info>,
}

#[account]
pub struct UserProfile {
    pub email: String,
    pub phone_number: String,
    pub owner: Pubkey,
    pub password: String,
    pub balance: u64,
}
'''

QUIET = '''// privacy-ignore-file [PRIV-016]
pub const SEED_KEY: &[u8] = b"0123456789abcdef";

pub fn total(price: u64) -> u64 {
    // price + 1 is only a comment
    price + 1
}

pub fn shown(name: String) {
    // privacy-ignore-next-line
    msg!("private {}", name);
    println!("{}", name);
}
'''


def sample_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("vault.rs", VAULT), ("quiet.rs", QUIET)], "file string, content string")


def _raw(spark: SparkSession, value) -> DataFrame:
    return spark.createDataFrame([("sample.json", json.dumps(value))], "path string, raw string")


def transfers(pairs: list[tuple[str, str, int]]) -> list[dict]:
    """Transactions of one native transfer each: (from, to, block time)."""
    return [{"signature": f"sig{i}", "blockTime": t, "nativeTransfers": [{"fromAddress": a, "toAddress": b, "amount": 1}]} for i, (a, b, t) in enumerate(pairs)]


def ledger_json(spark: SparkSession) -> DataFrame:
    logs = ["Program log: mnemonic leaked here", "0x" + "ab" * 62 + " end", "db_password=hunter2"]
    return _raw(spark, {"result": [*transfers([("A", "B", 100), ("A", "B", 110), ("A", "C", 120)]), {"signature": "logs", "blockTime": 5000, "rawLogs": logs, "instructions": [{"programId": "P", "data": "my mnemonic", "accounts": []}]}]})


def asset_json(spark: SparkSession) -> DataFrame:
    item = {"id": "asset_00001", "content": {"json_uri": "", "metadata": {"debug_mode": True}}, "creators": [{"address": "creator1", "verified": False, "share": 100}]}
    quoted = {"id": "asset_00042", "content": {"json_uri": "", "metadata": {"debug_mode": "true"}}, "creators": []}
    return _raw(spark, {"result": {"total": 2, "items": [item, quoted]}})


def metadata_json(spark: SparkSession) -> DataFrame:
    return _raw(spark, [{"mint": "M1", "onChainData": {"name": "John Smith"}, "offChainData": {"description": "Email: a@b.example"}}, {"mint": "M2", "onChainData": {"name": "Good Token"}}])
