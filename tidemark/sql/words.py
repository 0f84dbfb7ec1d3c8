"""Word tables of the MySQL dialect."""

#: Words that cannot be bare names.
RESERVED = frozenset("""
all and as asc between by case cross delete desc distinct div else end except exists for force from full group having
ignore in inner insert intersect into is join key left like limit lock mod natural not offset on or order outer partition
regexp right rlike select set straight_join then union update use using values when where window
""".split())

#: Words after which an opening parenthesis is no call and a sign is unary.
OPERATOR_WORDS = frozenset("""
all and any as between by case distinct div else exists from having in interval into is join like limit mod not offset on
or over partition recursive regexp return rlike rows select set some straight_join then union using value values when
where window with xor
""".split())

#: Aggregate functions.
AGGREGATES = frozenset("""
any_value approx_count_distinct avg bit_and bit_or bit_xor count count_big group_concat json_arrayagg json_objectagg max
min std stddev stddev_pop stddev_samp sum var_pop var_samp variance
""".split())

#: Functions that are called without parentheses.
NILADIC = frozenset("current_date current_time current_timestamp current_user localtime localtimestamp utc_date utc_time utc_timestamp".split())

#: Reserved words that still serve as bare names in expressions.
BARE_NAMES = frozenset("end offset full".split())

#: Further words that are no alias without AS.
NO_ALIAS = frozenset("with rollup lateral nowait skip escape sounds member collate over returning row dual".split()) | RESERVED

#: Statement kinds by first word.
KINDS = {
    "SELECT": "select table values",
    "INSERT": "insert",
    "UPDATE": "update",
    "DELETE": "delete",
    "REPLACE": "replace",
    "CALL": "call",
    "DDL": "create alter drop truncate rename",
    "TRANSACTION": "begin commit rollback start savepoint release xa",
    "UTILITY": "set show use explain describe desc analyze optimize check checksum repair flush kill grant revoke lock unlock load handler do prepare execute deallocate reset purge",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}
DML = frozenset(("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE"))
