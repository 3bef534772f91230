"""Spark types of the records, and the columns that tables of questions have."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD = f"struct<text:string,bbox:{BOX},conf:double,flag:string,alt:string>"
LINE = f"struct<page:int,words:array<{WORD}>,bbox:{BOX}>"
USAGE = "struct<calls:bigint,cached:bigint,input_tokens:bigint,output_tokens:bigint>"
PAGE = f"struct<index:int,width:int,height:int,source:string,engine:string,preprocess:array<string>,lines:array<{LINE}>,warnings:array<string>,edited_text:string,approved:boolean,ai_mode:string,quality:double,ai_usage:{USAGE}>"
OPTION = "struct<key:string,text:string>"
FLAG = f"struct<field:string,word:string,doc:string,page:int,bbox:{BOX},reason:string,alt:string>"
ISSUE = "struct<level:string,code:string,message:string,field:string>"
ARTICLE = "struct<law_key:string,law:string,kind:string,number:string,clause:string,source:string,field:string>"
CLASSIFICATION = "struct<subject_source:string,subject_confidence:double,topic_source:string,topic_confidence:double,section_path:array<string>>"
DUPLICATE = "struct<project_id:string,project_title:string,number:int,similarity:double>"
REGION = f"struct<doc:string,page:int,bbox:{BOX}>"
QUESTION = f"struct<number:int,subject_key:string,stem:string,options:array<{OPTION}>,correct_key:string,key_source:string,explanation:string,source_ref:string,topic:string,articles:array<{ARTICLE}>,classification:{CLASSIFICATION},regions:array<{REGION}>,flags:array<{FLAG}>,issues:array<{ISSUE}>,status:string,approved_by:string,duplicates:array<{DUPLICATE}>,edited:boolean>"
PROJECT = f"id string,title string,track string,year int,blueprint string,doc_type string,default_subject string,mode string,engine string,created_at timestamp,status string,questions array<{QUESTION}>,issues array<{ISSUE}>,page_status map<string,boolean>,batch_id string,auto_approve boolean"
