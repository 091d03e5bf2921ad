"""Vocabularies, patterns and constants that results depend on, in their semantic order."""

from __future__ import annotations

#: Field names that never are personal data on a ledger (whole name, lower case).
SAFE_FIELD_NAMES = """
mint authority owner payer recipient sender signer delegate creator admin operator token_account token_mint token_program associated_token
associated_token_program vault treasury escrow mint_authority freeze_authority token_a token_b token_0 token_1 base_token quote_token input_token
output_token reward_token lp_token program_id system_program rent clock instructions program pool_authority market_authority protocol_authority
fee_recipient fee_account liquidity total_liquidity pool_liquidity swap_fee protocol_fee trade_fee fee_rate fee_growth total_fees accumulated_fees
fees_owed total_supply circulating_supply reserve reserves reserve_a reserve_b balance token_balance sol_balance amount amount_in amount_out
min_amount max_amount price sqrt_price tick_price oracle_price volume total_volume trade_volume tvl total_value_locked pool pool_state pool_id
pool_address market market_id market_state amm amm_config amm_id vault_a vault_b vault_0 vault_1 tick tick_array tick_current tick_lower tick_upper
tick_spacing tick_index position position_state position_nft liquidity_net liquidity_gross oracle oracle_account price_feed pyth switchboard bump
nonce seed seeds discriminator lamports slot timestamp epoch index counter count length size status state is_initialized is_active decimals precision
reward rewards reward_rate reward_per_token staked stake_amount total_staked emission emissions_per_second collateral
""".split()
#: Parts of such names.
SAFE_FIELD_PATTERNS = """
_mint _authority _account _program _pubkey _bump _seed _vault _pool _oracle _signer _fee _fees _rate _price _token _liquidity _reserve _index _count
program_ token_ mint_ total_ accumulated_ protocol_
""".split()
SAFE_STRUCT_CONTEXTS = """
config settings params parameters metadata info data token mint pool vault reserve market oracle amm position tick state account program proposal vote
governance system global protocol
""".split()
SAFE_TYPES = """
Pubkey AccountInfo Signer Program Account UncheckedAccount SystemAccount AccountLoader InterfaceAccount Interface u8 u16 u32 u64 u128 i8 i16 i32 i64
i128 bool UnixTimestamp Slot Epoch Clock Rent
""".split()
PII_PATTERNS = """
email e_mail phone telephone mobile ssn social_security tax_id national_id passport driver_license date_of_birth dob birthdate birthday first_name
last_name full_name street city zip postal ip_address ip_addr
""".split()
SECRET_PATTERNS = """
password passwd pwd secret private_key secret_key api_key apikey auth_token access_token refresh_token bearer credential mnemonic seed_phrase
recovery_phrase
""".split()
FINANCIAL_CONTEXTS = """
swap transfer deposit withdraw withdrawal stake unstake liquidity pool mint burn borrow repay lend amount balance price fee reward token nft
collection
""".split()
PLACEHOLDER_EMAIL_DOMAINS = """
example.com example.org example.net test.com test.org localhost placeholder.com fake.com dummy.com sample.com foo.com bar.com
""".split()
TOKEN_METADATA_FIELDS = """
symbol decimals supply total_supply mint uri image description seller_fee_basis_points creators collection attributes properties
""".split()
NFT_METADATA_FIELDS = """
image animation_url external_url attributes collection seller_fee_basis_points creators properties edition token_id
""".split()
#: Programs whose activity is expected to cluster.
SYSTEM_PROGRAMS = """
TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb 11111111111111111111111111111111
ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL Stake11111111111111111111111111111111111111 StakeConfig11111111111111111111111111111111
Vote111111111111111111111111111111111111111 Config1111111111111111111111111111111111111 BPFLoaderUpgradeab1e11111111111111111111111
JUP6LkbZbjS1jKKwapdHNy74zcZ3tLUZoi5QNyVTaV4 JUP4Fb2cqiRUcaTHdrPC8h2gNsA2ETXiPDD33WcGuJB whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc
9W959DqEETiGZocYWCQPaJ6sBmUzgfxXfqGeTEdp3aQP CAMMCzo5YL8w4VFF8KVHrK22GGUsp5VTaW7grrKgrWqK 675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8
27haf8L6oxUeXrHrgEgsexjSY5hbVUWEmvv9Nyxg8vQv routeUGWgWzqBWFcrCfv8tritsqukccJPu3q5GPP3xS PhoeNiXZ8ByJGLkxNfZRnkUfjvmuYqLR89jjFHGqdXY
srmqPvymJeFKQ4zGQed1GFppgkRHL9kaELCbyksJtPX 9xQeWvG816bUx9EPjHmaT23yvVM2ZWbrrpZb9PusVFin opnb2LAfJYbRMAHHvqjCwQxanZn7ReEHp1k81EohpZb
LBUZKhRxPF3XUpBCjp4YzTKgLccjZhTSDM9YuVaPwxo Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB MFv2hWf31Z9kbCa1snEPYctwafyhdvnV7FZnsebVacA
6LtLpnUFNByNXLyCoK9wA2MykKAmQNZKBdY8s47dehDc So1endDq2YkqhipRh3WViPa8hdiSpxWy6z3Z6tMCpAo KLend2g3cP87ber41GKm4PvQCPGVyVW1rke66sJ5xKL
4UpD2fh7xH3VP9QQaXtsS1YY3bxzWhtfpks7FatyKvdY mv3ekLzLbnVPNxjSKvqBpU3ZeZXPQdEC3bp5MDEBG68 SPoo1Ku8WFXoNDMHPsrGSTSG1Y47rzgn41SLUNakuHy
MarBmsSgKXdrN1egZf5sqe1TMai9K1rChYNDJgjq7aD CgntPoLka5pD5fesJYhGmUCF8KU1QS1ZmZiuAuMZr2az J1toso1uCk3RLmjorhTtrVwY9HJ7X8V9yYac6Y7kGCPn
jitoVjT9jRUyeXHzvCwzPgHj7yWNRhLcUoXtes4wtjv BLZEEuZUBVqFhj8adcCFPJvPVCiCyVmh3hkJMrU8KuJA metaqbxxUerdq28cj1RbAWkYQm3ybzjb6a8bt518x1s
p1exdMJcjVao65QdewkaZRUnU6VPSXhus9n2GzWfh98 auth9SigNpDKz4sJJ1DfCTuZrZNSAgh9sFD3rboVmgg cndy3Z4yapfJBmL3ShUp5exZKqR3z33thTzeNMm2gRZ
CndyV3LdqHUfDLmE5naZjVN8rBZz4tqhdefbAnjHG3JR TSWAPaqyCSx2KABk68Shruf4rp7CxcNi8hAsbdwmHbN TCMPhJdwDryooaGtiocG1u3xcYbRpiJzb283XfCZsDp
M2mx93ekt1fmXSVkTrUL9xVFHkmME8HTUi5Cyc5aF7K M3mxk5W2tt27WGT7THox7PmgRDp4m6NEhL5xvxrBfS1 GovER5Lthms3bLBqWub97yVrMmEogzX7xNjdXpPPCVZw
gUAedF544JeE6NYbQakQvribHykUNgaPJqcgf3UQVnY pytS9TjG1qyAZypk7n8rw8gfW9sUaqqYyMhJQ4E7JCQ FsJ3A3u2vn5cTVofAjvy6y5kwABJAqYWpe4975bi2epH
pythWSnswVUd12oZpeFP8e9CVaEqJg25g1Vtc2biRsT SW1TCH7qEPTdLsDHRgPuMQjbQxKdH2aBStViMFnt64f
""".split()
SAFE_TX_TYPES = """
SWAP TRANSFER NFT_SALE NFT_LISTING NFT_CANCEL_LISTING NFT_BID NFT_MINT NFT_BID_CANCELLED TOKEN_MINT BURN BURN_NFT STAKE_TOKEN UNSTAKE_TOKEN STAKE_SOL
UNSTAKE_SOL CLAIM_REWARDS ADD_LIQUIDITY REMOVE_LIQUIDITY BORROW_FOX LOAN_FOX INIT_BANK INIT_STAKE MERGE_STAKE SPLIT_STAKE UPGRADE_PROGRAM_INSTRUCTION
FINALIZE_PROGRAM_INSTRUCTION
""".split()
KNOWN_SAFE_PROGRAMS = """
11111111111111111111111111111111 TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb
ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL metaqbxxUerdq28cj1RbAWkYQm3ybzjb6a8bt518x1s JUP6LkbZbjS1jKKwapdHNy74zcZ3tLUZoi5QNyVTaV4
whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc CAMMCzo5YL8w4VFF8KVHrK22GGUsp5VTaW7grrKgrWqK MFv2hWf31Z9kbCa1snEPYctwafyhdvnV7FZnsebVacA
So1endDq2YkqhipRh3WViPa8hdiSpxWy6z3Z6tMCpAo
""".split()
BPF_LOADERS = """
BPFLoader2111111111111111111111111111111111 BPFLoaderUpgradeab1e11111111111111111111111
""".split()
#: Words of log lines, in the order in which the first match counts.
LOG_WORDS = "user owner authority key secret private email address phone".split()
EVENT_WORDS = "amount balance lamports user owner authority recipient sender price fee total".split()
GLOBAL_SEED_PREFIXES = """
global config state protocol program admin settings params fee bridge guardian sequence emitter posted message wormhole vaa custody endpoint
relayer oracle price pool vault reserve treasury
""".split()
#: Words and phrases of seed-phrase leaks; substrings count.
SEED_WORDS = "abandon ability able about above absent absorb abstract absurd abuse access accident".split() + ["seed phrase", "recovery phrase", "mnemonic", "12 words", "24 words", "backup phrase", "secret words", "wallet words"]
SEED_PHRASES = ["seed phrase", "recovery phrase", "mnemonic", "12 words", "24 words", "backup phrase", "secret words", "wallet words"]
MEMO_WORDS = ["private", "secret", "password", "key", "cold wallet", "internal", "confidential", "ssn", "social security"]
DEBUG_PATTERNS = ["debug:", "trace:", "println!", "dbg!", "[debug]", "[trace]", "console.log", "console.debug", "log::debug", "log::trace", "DEBUG:", "TRACE:", ">>> ", "=== ", "--- ", "dumping", "inspecting", "raw bytes:", "hex dump"]
KEY_MARKERS = ["private_key", "secret_key", "0x4a5f"]
PERSONAL_PREFIXES = "home_ mailing_ billing_ shipping_ street_ postal_".split()
SAFE_SUFFIXES = "_hash _hashed _encrypted _cipher _digest _commitment".split()
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
WEIGHTS = [0, 5, 10, 25, 40]
#: Expressions (without blanks) that end a flow of sensitive data.
SANITIZERS = """
hash( digest( finalize( sha256( sha512( sha3( Sha256:: Sha512:: Sha3:: keccak256( keccak( Keccak256:: blake2( blake2b( blake2s( blake3( Blake2::
Blake3:: poseidon( Poseidon:: solana_program::hash:: hashv( anchor_lang::solana_program::hash hash_to_ Hash:: encrypt( seal( cipher( aes_encrypt
chacha_encrypt Aes:: ChaCha:: box_seal secretbox encrypt_message elgamal verify( ed25519_verify( verify_signature( secp256k1_recover
keccak_secp256k1 signature.verify Signature::verify require!( require_eq!( require_neq!( require_gt!( require_gte!( require_keys_eq!(
require_keys_neq!( assert!( assert_eq!( assert_ne!( debug_assert! ensure!( invariant!( checked_add checked_sub checked_mul checked_div
checked_rem checked_pow checked_shl checked_shr saturating_add saturating_sub saturating_mul commitment( pedersen( Pedersen:: blind( mask(
nullifier( truncate( redact( mask_pii( anonymize(
""".split()
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+[0-9]{1,3}[-. \t][0-9]{3}[-. \t][0-9]{3}[-. \t][0-9]{4}|\([0-9]{3}\)[ \t]?[0-9]{3}[-. \t][0-9]{4}"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
#: Personal data in account payloads (lower case).
ACCOUNT_PII = [
    r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"\+?1?[ \t]?\(?[0-9]{3}\)?[ \t.-]?[0-9]{3}[ \t.-]?[0-9]{4}",
    r"(first_name|last_name|ssn|passport|phone|email|birth)",
    r"api[_-]?key",
]

# Fixed values of the source rules, as they must be for right results.
#: Folders that hold no program sources.
SKIPPED_DIRS = """
target sdk client generated examples wasm cli tests cosmwasm evm ethereum aptos sui terra algorand near
""".split()
#: Folders below the root are read to this depth.
MAX_DEPTH = 50
#: Context that makes a call's target known.
SAFE_CPI = """
system_instruction:: spl_token::instruction:: spl_token_2022::instruction:: spl_token::id() system_program::id() anchor_spl:: &spl_token::ID &system_program::ID
""".split()
#: What makes a seed dynamic: calls, and names outside byte strings.
SEED_CALLS = [".key()", ".as_ref()", ".to_le_bytes()", ".to_bytes()"]
SEED_NAMES = ["authority", "owner", "payer", "signer"]
#: Names of addresses that are meant to be enumerable.
ENUMERABLE_NAMES = ["pool", "vault", "reserve", "market", "oracle", "tick", "bridge", "guardian", "wormhole", "custody", "emitter"]
#: Patterns of the source rules.
AUTHORITY_FIELD = r"pub\s+(\w*authority\w*)\s*:\s*(?:Account|AccountInfo|UncheckedAccount)"
MUT_ACCOUNT = r"#\[account\s*\(\s*mut\s*(?:,|[^\)]*)\s*\)\]"
CPI_CALL = r"invoke(?:_signed)?\s*\("
CLOSED = r"close\s*=\s*(\w+)"
MATH = r"(?:amount|balance|lamports|total|fee|price)\s*[\+\-\*]\s*"
RAW_READ = r"(?:try_from_slice|try_deserialize|try_borrow_data)\s*\("
#: Context that checks a discriminator.
DISCRIMINATORS = ["discriminator", "DISCRIMINATOR", "try_deserialize", "Account::try_from"]
#: Endings of expressions that tell nothing of a value.
SAFE_ENDINGS = [".len()", ".is_some()", ".is_none()", ".is_empty()", ".contains", ".starts_with", ".ends_with"]
#: Names of carriers that mean no person, and words that do.
GENERIC_CARRIERS = ["field_name", "account_name", "name_str", "label", "tag", "key_name", "param_name", "arg_name", "var_name", "type_name", "struct_name"]
PERSONAL_CARRIERS = ["user", "pii", "email", "phone", "secret", "private", "ssn", "password"]
#: Words of the context of a line.
PROTECTION_WORDS = ["hash(", "sha256", "encrypt", "cipher", "commitment"]
VALIDATION_WORDS = ["require!", "assert!", "constraint", "has_one", "verify"]
MOCK_WORDS = ["mock", "fixture", "example", "sample", "test_", "_test", "dummy"]
PLACEHOLDER_WORDS = ["example.com", "placeholder", "xxx", "todo"]
#: Words that a transaction's description is searched for.
TX_WORDS = ["swap", "transfer", "mint", "burn", "stake", "deposit", "withdraw", "borrow", "lend", "pool", "liquidity"]
