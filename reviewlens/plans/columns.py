"""Result columns of the queries that have DuckDB SQL.

Both sides are cast to them: the Spark result in ``catalog.register`` and the SQL
in ``catalog.oracle_sql`` (doubles are rounded to 6 places on both sides).
"""

RESULT_COLUMNS = {
    "a10_label_value_counts": "label bigint, count bigint",
    "a10_predicted_label_value_counts": "Predicted_Label bigint, count bigint",
    "a12_compound_bin_pivot": "Bin string, label_0 bigint, label_1 bigint",
    "a13_compound_histogram": "bin bigint, bin_lo double, bin_hi double, count bigint",
    "a13_length_histogram": "bin bigint, bin_lo double, bin_hi double, count bigint",
    "a13_polarity_histogram": "bin bigint, bin_lo double, bin_hi double, count bigint",
    "a13_subjectivity_histogram": "bin bigint, bin_lo double, bin_hi double, count bigint",
    "a14_confusion_matrix": "label bigint, predicted bigint, n bigint",
    "a15_rule_accuracy": "accuracy double",
    "a16_classification_report": "class string, precision double, recall double, f1_score double, support bigint",
    "a17_row_counts": "rows_before bigint, rows_after bigint",
    "a1_reviewer_counts": "reviewerID string, review_count bigint",
    "a2_segment_counts": "segment_no bigint, reviewTot_segment string, count bigint",
    "a5_a6_product_statistics": "productId string, reviews_per_product bigint, reviewers_per_product bigint, product_earliest_review date, product_latest_review date, product_review_interval bigint",
    "a7_a8_a9_length_summary": "count bigint, mean double, stddev double, min bigint, max bigint, corr_label double, p25 bigint, p50 bigint, p75 bigint",
    "a7_compound_corr": "corr_compound_label double",
    "a8_describe_length": "count bigint, mean double, stddev double, min bigint, max bigint",
    "a9_length_percentiles": "p25 bigint, p50 bigint, p75 bigint",
    "d5_review_dates": "reviewID string, reviewTime date, year bigint, month bigint, day_of_week bigint, age bigint, days_since_2000 bigint",
    "e1_helpful_rate_by_age": "age bigint, n bigint, helpful_rate double",
    "e1_helpful_rate_by_day_of_week": "day_of_week bigint, n bigint, helpful_rate double",
    "e1_helpful_rate_by_month": "month bigint, n bigint, helpful_rate double",
    "e1_helpful_rate_by_year": "year bigint, n bigint, helpful_rate double",
    "e2_length_ratio": "mean_length_helpful double, mean_length_not_helpful double, ratio double",
    "e3_helpful_rate_by_subjectivity_bin": "Bin_Sen string, n bigint, helpful_rate double",
    "e3_subjectivity_bin_label_counts": "Bin_Sen string, label bigint, count bigint",
    "e4_helpful_rate_by_polarity_bin": "Bin_Pol string, n bigint, helpful_rate double",
    "e4_polarity_bin_label_counts": "Bin_Pol string, label bigint, count bigint",
    "e5_helpful_rate_by_length": "segment_no bigint, reviewTot_segment string, n bigint, helpful_rate double",
    "e6_compound_bin_label_counts": "Bin string, label bigint, count bigint",
    "j1_j2_counts_joined_back": "reviewID string, reviewerID string, productId string, review_count bigint, productId_count bigint",
    "j3_w1_product_features": "productId string, reviewerID string, reviewID string, reviewTime date, reviews_per_product bigint, reviewers_per_product bigint, product_review_interval bigint, reviewOrder bigint",
    "lg_feature_rows": "reviewID string, reviewerID string, productId string, verified bigint, overall double, label bigint, reviewTime date, year bigint, month bigint, day_of_week bigint, age bigint, review_count bigint, productId_count bigint, reviews_per_product bigint, reviewers_per_product bigint, product_review_interval bigint, reviewOrder bigint, polarity_score double, sentiment_score double, combined_text_length bigint, combined_text string",
    "m11_auc_compound": "auc double",
    "m11_auc_length": "auc double",
    "m11_auc_polarity": "auc double",
    "m12_m13_rule_metrics": "accuracy double, weighted_precision double, weighted_recall double",
    "m2_hash_split_counts": "part string, rows bigint, labelled bigint",
    "n11_normalized_tokens": "reviewID string, n_normalized bigint, normalized string",
    "n12_lemmatized_tokens": "reviewID string, n_lemmas bigint, lemmas string",
    "n13_marked_unknown_words": "reviewID string, marked_text string",
    "n1_regex_tokens": "reviewID string, n_words bigint, words string",
    "n2_n14_stop_words_removed": "reviewID string, n_filtered bigint, filtered string",
    "n4_bigrams": "reviewID string, n_bigrams bigint, bigrams string",
    "n5_term_frequency_vocabulary": "term string, doc_freq bigint, term_freq bigint",
    "n6_inverse_document_frequency": "term string, doc_freq bigint, idf double",
    "n8_string_index_reviewers": "reviewerID string, index bigint",
    "p10_dedup_line_reviews": "reviewerID string, asin string, unixReviewTime bigint, reviewID string",
    "p10_dedup_reviews": "reviewID string, reviewerID string, asin string, unixReviewTime bigint",
    "p11_quality_report": "rows bigint, distinct_keys bigint, null_reviewText bigint, null_summary bigint, null_label bigint",
    "p1_review_columns": "reviewID string, reviewerID string, productId string, verified bigint, overall double, label bigint, reviewTime date, year bigint, month bigint, day_of_week bigint, age bigint, reviewTot string",
    "p9_drop_missing": "reviewID string, label bigint",
    "s1_scan_reviews": "reviewID string, reviewerID string, asin string, reviewText string, summary string, verified boolean, overall double, unixReviewTime bigint, label bigint",
    "s2_scan_scoring": "reviewID string, reviewerID string, asin string, reviewText string, summary string, verified boolean, overall double, unixReviewTime bigint",
    "s3_hash_sample": "reviewID string, reviewerID string, label bigint, bucket bigint",
    "s8_s6_length_rows_csv_round_trip": "reviewID string, label bigint, reviewTot_length bigint, segment_no bigint, reviewTot_segment string",
    "t3_t6_clean_text": "reviewID string, combined_text_length bigint, combined_text string, clean_length bigint",
    "w1_recency_order_hot_products": "reviewID string, productId string, reviewTime date, reviewOrder bigint",
    "z1_z3_sentiment_scores": "reviewID string, label bigint, compound_score double, polarity_score double, sentiment_score double",
    "n8_string_index_products": "productId string, index bigint",
    "p3_drop_list": "reviewID string, reviewerID string, overall double",
    "n6_bigram_document_frequency": "term string, doc_freq bigint, idf double",
    "n7_scaled_tf_idf": "reviewID string, n_terms bigint, sum_tf_idf double, max_scaled double",
    "n7_scaled_bigram_tf_idf": "reviewID string, n_terms bigint, sum_tf_idf double, max_scaled double",
    "n9_n7_scaled_scalars": "reviewID string, overall_scaled double, month_scaled double, length_scaled double",
    "m14_pr_length": "area_under_pr double",
    "m19_class_weights": "label bigint, n bigint, class_weight double",
    "m17_scored_ids": "reviewID string",
    "j2_bucketed_product_counts": "reviewID string, reviewerID string, productId string, productId_count bigint",
    "j3_w1_bucketed_product_features": "productId string, reviewerID string, reviewID string, reviewTime date, reviews_per_product bigint, reviewers_per_product bigint, product_review_interval bigint, reviewOrder bigint",
    "m17_point_in_time_statistics": "reviewID string, known_reviews bigint, known_reviewers bigint, known_interval bigint, known boolean",
    "a5_merged_reviewers_per_product": "productId string, reviewers bigint",
    "n3_positive_pmi": "a string, b string, n bigint, ppmi double",
    "m19_oversampled_class_counts": "label bigint, rows bigint, synthetic bigint",
}
