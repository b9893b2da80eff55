"""Inputs of the registered queries, derived from the given tables.

The given prose has no titled names, company words, numeric dates or source code.  So a closing
sentence is added to every document, and a source file is written for every part, from their own
columns.  The expressions are plain SQL and are used as they stand on both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.tables import load, spread


def sql_literal(text: str) -> str:
    """A string expression without escapes, equal on both engines."""
    special = {"\n": "chr(10)", "'": "chr(39)", "\\": "chr(92)", "\t": "chr(9)"}
    parts = []
    for piece in re.split(r"([\n'\\\t])", text):
        if piece in special:
            parts.append(special[piece])
        elif piece:
            parts.append(f"'{piece}'")
    return ", ".join(parts) if parts else "''"


def sql_template(template: str, values: dict[str, str]) -> str:
    """``concat(...)`` of a text with ``{name}`` places filled by SQL expressions."""
    parts = []
    for piece in re.split(r"(\{[A-Za-z0-9_]+\})", template):
        if re.fullmatch(r"\{[A-Za-z0-9_]+\}", piece) and piece[1:-1] in values:
            parts.append(values[piece[1:-1]])
        elif piece:
            parts.append(sql_literal(piece))
    return "concat(" + ", ".join(parts) + ")"


def pick(words: str, number: str) -> str:
    """One word of a comma list, chosen by a number."""
    return f"split_part('{words}', ',', CAST({number} % {words.count(',') + 1} + 1 AS INT))"


def text_of(number: str) -> str:
    return f"CAST({number} AS STRING)"


NOTE = sql_template(
    "{text}\nOn {m}/{d}/{y} Dr. {first} {last} of {place} Light {word} moved from {a} to {b} with Nova {n} Pro. "
    "Signed {y}-{m}-{d}, {d} March {y} and May {d}, {y} at {n} Main Street in {c} by ACME.\n"
    "{first} {last} met Prof. {last} {first} at {a} again: Delta Max or {first} Corp x {last} Inc.",
    {
        "text": "text",
        "m": text_of("doc_id % 12 + 1"), "d": text_of("doc_id % 28 + 1"), "y": text_of("1990 + doc_id % 30"),
        "n": text_of("doc_id % 90 + 1"),
        "first": pick("Anna,Maria,John,Erik,Paula", "doc_id"),
        "last": pick("Berg,Olsen,Smith,Keller,Moreau,Diaz,Novak", "doc_id"),
        "place": pick("Harbor,River,Summit", "doc_id"),
        "word": pick("Company,Group,University,Agency,Institute,Foundation", "doc_id"),
        "a": pick("Paris,Tokyo,New York,Oslo Nord,Berlin", "doc_id"),
        "b": pick("London,Rome Centrale,Los Angeles,Canada", "doc_id"),
        "c": pick("Dubai,Lima,Spain", "doc_id"),
    },
)
NOTES_SQL = f"SELECT doc_id, {NOTE} AS text, lang, source FROM documents"


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a closing note made of their own columns."""
    docs = spread(load(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return docs.withColumn("text", F.expr(NOTE))


CODE_TEMPLATES = {
    "py": """import numpy
import os.path
from {w1}.{w2} import {w2}_tools
"""
    + '"""Tools for {w1}."""'
    + """
MAX_{W1} = {n}
@{w1}.register
class {Cls}(Base):
    def {w2}(self, x) -> int:
        return self.{w2}_{n}(x)
def make_{w1}(a, b):
    return {Cls}(a)
""",
    "js": """import React from 'react'
const util = require('{w1}-{w2}')
const MAX_{W1} = {n}
function {Cls}(props) {
  const [{w1}, set{Cls}] = useState({n})
  use{Cls2}({w1})
  return run_{w2}(props)
}
const {Cls}Box = (p) => p
{w1}: function (x)
{w2} = function(y)
class {Cls}View extends React.Component {
""",
    "ts": """import { {Cls} } from './{w1}'
export interface {Cls}Props {
  name: string
}
type {Cls2}Id = {w2}
type {Cls}Map = {
enum {Cls2} {
let LIMIT_{N} = {n}
function load{Cls}(id: string) {
  return fetch(id)
}
""",
    "java": """package com.{w1}.{w2};
import java.util.List;
@Override
public class {Cls}<T extends {Cls2}> {
  static final int MAX_{W1} = {n};
  public static int {w2}(int a, int b) {
    return run(a);
  }
}
public interface {Cls2}Api {
Map<K, V> of = null;
""",
    "cpp": """#include <vector>
#include "{w1}.h"
#define MAX_{W1} {n}
#ifdef {W2}
namespace {w1} {
template <typename T>
struct {Cls} {
class {Cls2} {
int {w2}(int x) {
if ready(x)
""",
    "c": """#include <stdio.h>
struct {w1} {
int {w2}(int x, int y) {
while busy(x)
void run_{w1}(void)
#pragma once
""",
    "go": """package {w1}
import (
type {Cls} struct {
type {Cls2} interface {
func (s *{Cls}) {w2}(x int) error {
func (s {Cls}) get_{w1}() int {
func make_{w1}(n int)
""",
    "rb": """require '{w1}'
module {Cls}
class {Cls2} < Base
  has_many :{w1}_items
  belongs_to :{w2}
  validates :name
  scope :recent
  def {w2}(x)
    puts x
  end
end
""",
    "php": """namespace App\\{Cls};
use {Cls2}::Base;
trait {Cls}Trait
class {Cls} {
  public function {w1}($x) {
  private function {w2}($y) {
""",
    "rs": """use std::{w1};
struct {Cls} {
enum {Cls2} {
trait {Cls}Like {
impl Display for {Cls} {
fn {w2}(x: i32) {
    println!("{w1}");
""",
    "sh": """#!/bin/bash
{W1}_DIR=/tmp/{w1}
RATE=1
run_{w1}() {
  echo {n} | grep {w2}
  curl {w1} && rm {w2}
}
clean()
{
  find . -name {w1}
}
""",
}
_N = "p_partkey"
_WORD = {i: f"replace(split_part(p_name, ' ', {i}), '-', '')" for i in (1, 2)}


def _capital(word: str) -> str:
    return f"concat(upper(substr({word}, 1, 1)), substr({word}, 2, 20))"


_VALUES = {
    "w1": _WORD[1], "w2": _WORD[2], "W1": f"upper({_WORD[1]})", "W2": f"upper({_WORD[2]})",
    "Cls": _capital(_WORD[1]), "Cls2": _capital(_WORD[2]), "n": text_of("p_size"),
    "N": pick("A,B,C", _N),
}
_SUFFIXES = ",".join(CODE_TEMPLATES)
CODE_PATH = f"concat('src/', replace(p_name, ' ', '_'), '_', {text_of(_N)}, '.', {pick(_SUFFIXES, _N)})"
CODE_TEXT = (
    f"CASE CAST({_N} % {len(CODE_TEMPLATES)} AS INT) "
    + " ".join(f"WHEN {i} THEN {sql_template(t, _VALUES)}" for i, t in enumerate(CODE_TEMPLATES.values()))
    + " END"
)
# Language per suffix of the written files.
CODE_LANGUAGE = (
    "CASE suffix WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' "
    "WHEN 'java' THEN 'java' WHEN 'cpp' THEN 'cpp' WHEN 'c' THEN 'c' WHEN 'go' THEN 'go' "
    "WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'rs' THEN 'rust' WHEN 'sh' THEN 'bash' END"
)
CODE_SQL = (
    f"SELECT p_partkey, {CODE_PATH} AS path, {pick(_SUFFIXES, _N)} AS suffix, {CODE_TEXT} AS text FROM part"
)


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """A source file per part: its path and text, in eleven languages."""
    part = spread(load(spark, folder, "part").select("p_partkey", "p_name", "p_size"))
    return part.select("p_partkey", F.expr(CODE_PATH).alias("path"), F.expr(CODE_TEXT).alias("text"))


# A log record per event.
LOG_LINE = (
    "concat('{\"timestamp\":\"', {ts}, '\",\"level\":\"', "
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'debug' "
    "ELSE 'info' END, '\",\"message\":\"', event_type, ' by ', CAST(user_id AS STRING), "
    "'\",\"context\":{\"module\":\"', event_type, '\",\"function\":\"f', CAST(user_id % 7 AS STRING), "
    "'\",\"line\":', CAST(event_id % 500 AS STRING), '}}')"
)
LOG_SQL = LOG_LINE.replace("{ts}", "strftime(ts, '%Y-%m-%dT%H:%M:%S')")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON log line per event; the file is its type, the number its id."""
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    events = load(spark, folder, "events")
    return events.select(
        F.col("event_type").alias("file"), F.col("event_id").alias("n"),
        F.expr(LOG_LINE.replace("{ts}", stamp)).alias("line"),
    )


# A profile record per event: the type is the operation, the value in hundredths its duration.
PROFILES_SQL = (
    "SELECT event_id, event_type AS operation, CAST(round(value * 100) AS BIGINT) AS duration_ms, ts, "
    "CAST(user_id AS BIGINT) AS mem_diff, CAST(event_id % 100 AS BIGINT) AS cpu FROM events"
)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("operation"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"), "ts",
        F.col("user_id").cast("long").alias("mem_diff"), (F.col("event_id") % 100).cast("long").alias("cpu"),
    )


# A batch item per order line: the order is the batch, flags give the state.
ITEM_STATUS = (
    "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'completed' "
    "WHEN l_quantity < 3 THEN 'skipped' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'processing' END"
)
ITEMS_SQL = (
    "SELECT l_orderkey AS batch_id, l_linenumber AS line, l_partkey AS part, "
    f"{ITEM_STATUS} AS status, CAST(l_quantity AS BIGINT) AS duration_ms, "
    "CAST(l_quantity AS BIGINT) % 5 AS priority, l_shipdate AS started_at, "
    "CAST(l_shipdate AS TIMESTAMP) + to_milliseconds(CAST(l_quantity AS BIGINT)) AS completed_at FROM lineitem"
)


def batch_items(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), F.expr(ITEM_STATUS).alias("status"),
        F.col("l_quantity").cast("long").alias("duration_ms"),
        (F.col("l_quantity").cast("long") % 5).alias("priority"),
        F.col("l_shipdate").alias("started_at"),
        F.timestamp_add("MILLISECOND", F.col("l_quantity").cast("long"), F.col("l_shipdate").cast("timestamp_ntz")).alias("completed_at"),
    )
